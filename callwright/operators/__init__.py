"""DataFrame operators: calls, index, profile, rules, chat, evaluate, augment, pairing, repair, prompts."""
