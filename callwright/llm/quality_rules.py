"""Quality rules by distribution divergence.

Each document has two histograms: character classes, and the most common words of its language.  The
reference of a language is the median histogram of its documents (medians on a grid of thousandths:
exact, from counts alone, and unmoved by junk in less than half of them).  A document whose histogram
lies further from the reference than a limit, in Jensen-Shannon distance (base 2), is rejected, and so
is one whose common words lie clearly nearer to the reference of another listed language (languages share
words, so text in the wrong one can pass the limit); texts too short for a steady histogram are spared
(minimum-length guards).  Simple counts come first.

All of it is built-in functions.  Each text is read once and its counts are taken inside its row, so
no text is shuffled.  The counts, one small row for each document, are written to the shared folder,
since the references and the verdicts both need them.

Defined results: a null text has no words and fails the base rules; a null or unlisted language is
compared with the median over all documents and has no common words; equal rows fare alike, each has
its own result; an empty table gives no rows; columns of the input may have any names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_back, own_columns, staged

# Common function words of the languages.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los"],
}
LISTED = sorted({w for v in COMMON.values() for w in v})
# Character classes as patterns; white space and all others are counted as rests.
CLASSES = {"upper": r"\p{Lu}", "symbol": "[#*$%&|<>]"}
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
GRID = 1000

MIN_WORDS = 50
MIN_CHARS = 200  # for the character histogram
MIN_COMMON = 100  # words, for the word histogram
MAX_CLASS_DISTANCE = 0.14
# No common word at all lies 0.264 (es) to 0.273 (en, de, fr) from the references of sf0.1; its clean texts
# of 100 words or more reach 0.209, and are at most 0.035 nearer to another language than to their own.
MAX_WORD_DISTANCE = 0.235
LANG_MARGIN = 0.04

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays that add up to one."""

    def term(a, b):
        half = (a + b) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / half)).otherwise(0.0)
        return (part(a) + part(b)) / 2

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x)))


def repeat_words() -> Column:
    """Words inside 3-word windows found twice or more, from ``windows``, the windows' hashes in order.
    Sorted with their starts, equal windows are neighbours; overlapping ones count a word once."""
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts_of(s):
        both = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

    # the sorted array is read twice: aggregate binds it, else it would be sorted twice
    starts = F.aggregate(F.array(placed), F.array().cast("array<int>"), lambda _, s: starts_of(s))
    step = lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"))
    covered = F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step)["n"]
    return F.when(F.size("windows") > F.size(F.array_distinct("windows")), covered).otherwise(0).cast("bigint")


def share(x: Column, total: str) -> Column:
    return F.coalesce(F.try_divide(x.cast("double"), F.col(total).cast("double")), F.lit(0.0))


def word_hist(lang: str) -> Column:
    """Shares of the common words of a language and of all other words, from ``hits`` (counts of ``LISTED``)."""
    hits = [F.get("hits", F.lit(LISTED.index(w))).cast("bigint") for w in COMMON[lang]]
    return F.array(*[share(x, "n_words") for x in [*hits, F.col("n_words") - sum(hits[1:], hits[0])]])


def counted(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, lang) -> doc_id, lang_key, the counts, base_failed, both histograms and hits."""
    lang = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise("*")
    rows = rows.select("doc_id", lang.alias("lang_key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words_of(F.col("text")))
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        "lang_key",
        F.filter("words", lambda w: w.isin(*LISTED)).alias("common"),
        F.array(*map(F.lit, LISTED)).alias("list"),
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        *[F.regexp_count("text", F.lit(p)).cast("bigint").alias(f"n_{k}s") for k, p in CLASSES.items()],
        lines.alias("lines"),
        hashes.alias("one"),
    )
    pair = lambda a, b: F.xxhash64(a, b)
    after = lambda k: F.slice("one", k + 1, F.greatest(F.size("one") - k, F.lit(0)))
    three = F.zip_with(F.zip_with("one", after(1), pair), after(2), pair)  # the last two are cut off below
    rows = rows.select(*[c for c in rows.columns if c not in ("lines", "one")], F.slice(three, 1, F.greatest(F.size("one") - 2, F.lit(0))).alias("windows"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"))
    rows = rows.select(*[c for c in rows.columns if c != "windows"], repeat_words().alias("n_repeat_words"))
    # "common" is read twice here: what is read once is merged into the lambda and found anew each time
    hits = F.transform("list", lambda x: F.size(F.filter("common", lambda w: w == x)))
    rows = rows.select("*", F.when(F.size("common") > 0, hits).otherwise(F.transform("list", lambda x: F.lit(0))).alias("hits"))
    classes = [F.col(f"n_{k}s") for k in CLASSES]
    classes += [F.col("n_chars") - F.col("word_chars"), F.col("word_chars") - sum(classes[1:], classes[0])]
    found = F.array(share(F.col("n_words"), "n_words"))  # no list: all words are the rest
    for k in COMMON:
        found = F.when(F.col("lang_key") == k, word_hist(k)).otherwise(found)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", "lang_key", "n_chars", *COUNTS, failed.alias("base_failed"), F.array(*[share(c, "n_chars") for c in classes]).alias("class_hist"), found.alias("word_hist"), "hits")


def reference(counts: DataFrame) -> DataFrame:
    """ref_key, class_ref, word_ref: the median histograms of each listed language, and of all
    documents (key *): one row for each listed language and one more at most."""
    grown = counts.where((F.col("n_words") >= MIN_WORDS) & (F.col("n_chars") >= MIN_CHARS))
    keys = F.explode(F.array_distinct(F.array("lang_key", F.lit("*")))).alias("key")
    cell = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("bin"), F.round(x * GRID).cast("int").alias("cell"))
    cells = grown.select(keys, "class_hist", "word_hist").select("key", F.inline(F.concat(F.transform("class_hist", cell("c")), F.transform("word_hist", cell("w")))))
    cells = cells.groupBy("key", "kind", "bin", "cell").count()
    w = Window.partitionBy("key", "kind", "bin")  # over the cells of one bin, GRID + 1 at most
    cells = cells.select("*", F.sum("count").over(w.orderBy("cell")).alias("upto"), F.sum("count").over(w).alias("every"))
    middle = cells.where(F.col("upto") * 2 >= F.col("every")).groupBy("key", "kind", "bin").agg((F.min("cell") / F.lit(float(GRID))).alias("x"))
    values = F.transform(F.sort_array(F.collect_list(F.struct("bin", "x"))), lambda s: s["x"])
    arrays = middle.groupBy("key", "kind").agg(values.alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    arrays = arrays.select("key", "kind", "v", total.alias("total")).select("key", "kind", F.transform("v", lambda x: F.try_divide(x, F.col("total"))).alias("v"))
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("v")))
    return arrays.groupBy(F.col("key").alias("ref_key")).agg(pick("c").alias("class_ref"), pick("w").alias("word_ref"))


def verdicts(rows: DataFrame, max_class: float, max_word: float) -> DataFrame:
    counts = staged(counted(rows), "quality-counts")
    every = reference(counts).agg(F.collect_list(F.struct("ref_key", "class_ref", "word_ref")).alias("refs"))  # one row
    of = lambda key: F.get(F.filter("refs", lambda r: r["ref_key"] == key), F.lit(0))
    out = counts.crossJoin(F.broadcast(every)).select("*", of(F.col("lang_key")).alias("own"), *[of(F.lit(k))["word_ref"].alias(f"ref_{k}") for k in COMMON])
    out = out.select("*", F.col("own.class_ref").alias("class_ref"), F.col("own.word_ref").alias("word_ref"))
    others = [F.when((F.col("lang_key") != k) & F.col(f"ref_{k}").isNotNull(), js_distance(word_hist(k), F.col(f"ref_{k}"))) for k in COMMON]
    out = out.select("*", F.least(*others).alias("other_distance"), js_distance(F.col("class_hist"), F.col("class_ref")).alias("class_distance"), js_distance(F.col("word_hist"), F.col("word_ref")).alias("word_distance"))
    far = F.coalesce((F.col("n_chars") >= MIN_CHARS) & (F.col("class_distance") > max_class), F.lit(False))
    elsewhere = F.coalesce(F.col("word_distance") > F.col("other_distance") + LANG_MARGIN, F.lit(False))
    strange = F.coalesce((F.col("n_words") >= MIN_COMMON) & (F.col("lang_key") != "*") & ((F.col("word_distance") > max_word) | elsewhere), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far & ~strange)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """doc_id, the counts, base_failed, kept, class_distance, word_distance of every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    return verdicts(rows, max_class, max_word).select("doc_id", *COUNTS, "base_failed", "kept", "class_distance", "word_distance")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns (found again by id, text and language)."""
    own = own_columns(docs, id_col, text_col)
    lang = F.col(f"own_{docs.columns.index(lang_col)}")
    own = own.withColumn("lh", F.xxhash64(lang))
    rows = own.select(F.struct("did", "th", "lh").alias("doc_id"), "text", lang.alias("lang"))
    kept = verdicts(rows, max_class, max_word).where("kept").select("doc_id.*")
    return own_back(own.join(kept, ["did", "th", "lh"], "left_semi"), docs)
