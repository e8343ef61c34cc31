"""JSON text checks as Column expressions.

``strict_json`` parses only text that a strict JSON reader accepts as one whole
value: trailing text after the value makes it null (``1, "x": 2``, ``{..} junk`` and
``{..}}`` are rejected while every single JSON value passes).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .args import float_text, json_string, pystrip


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_json(c) -> Column:
    """VARIANT of the text when it is exactly one JSON value, else null.

    Two streaming parses reject trailing text, empty text and value lists: as the only element of an
    array and as the value of an object member; text that ends the one early is an error in the other
    (``{}]`` and ``{}}``).  The VARIANT parse then rejects what the variant format cannot hold (duplicate
    keys, NaN)."""
    return F.when(_one_value(_col(c)), F.try_parse_json(_col(c)))


def _one_value(t: Column) -> Column:
    one_element = F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1
    one_member = F.json_object_keys(F.concat(F.lit('{"v":'), t, F.lit("}"))).isNotNull()
    return one_element & one_member


def normalise_json(c) -> Column:
    """Compact, key-sorted JSON text of a valid value; null when the text is not JSON."""
    return F.to_json(strict_json(c))


#: tokens of JSON text that is known to be valid; commas, colons and white space say nothing more
TOKEN_RE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{}]|[^\s,:\[\]{}"]+'
_MEMBERS = "array<struct<k:string,v:string>>"
_STACK = f"array<struct<obj:boolean,named:boolean,key:string,m:{_MEMBERS}>>"


def json_dumps(c, sort_keys: bool = False, flat: bool = False) -> Column:
    """The value written anew as compact JSON the way Python's ``json`` reads and writes it.

    ``1.0`` stays apart from ``1``, keys keep the text's order (or are sorted), of a repeated key the last value
    counts at the first one's place, escapes become signs.  ``flat`` writes the elements of an outer array one
    behind the other.  Null where the text is not one JSON value.

    A fold over the tokens: open containers on a stack, each closed one becomes a text in the container around
    it.  A container is copied for each of its members, so one with very many members is slow, not wrong.
    """
    t = _col(c)
    words = lambda x: F.get_json_object(F.concat(F.lit("["), x, F.lit("]")), "$[0]")
    whole = lambda x: F.when(x == "-0", F.lit("0")).otherwise(x)

    def read(x):
        text, number = x.startswith('"'), x.rlike("^-?[0-9]")
        plain = F.when(text, words(x))
        fraction = x.rlike("[.eE]")
        value = F.when(text, json_string(words(x))).when(number & fraction, float_text(x.try_cast("double"))).when(number, whole(x)).otherwise(x)
        return F.struct(x.alias("t"), plain.alias("plain"), value.alias("v"))

    def render(frame, outer):
        members = F.array_sort(frame["m"]) if sort_keys else frame["m"]
        named = F.array_join(F.transform(members, lambda m: F.concat(json_string(m["k"]), F.lit(":"), m["v"])), ",")
        listed = lambda sep: F.array_join(F.transform(frame["m"], lambda m: m["v"]), sep)
        array = F.concat(F.lit("["), listed(","), F.lit("]"))
        if flat:
            array = F.when(outer, listed("")).otherwise(array)
        return F.when(frame["obj"], F.concat(F.lit("{"), named, F.lit("}"))).otherwise(array)

    def put(frame, value):
        member = F.struct(frame["key"].alias("k"), value.alias("v"))
        again = frame["obj"] & F.exists(frame["m"], lambda m: m["k"] == frame["key"])
        members = F.when(again, F.transform(frame["m"], lambda m: F.when(m["k"] == frame["key"], member).otherwise(m))).otherwise(F.concat(frame["m"], F.array(member)))
        return F.struct(frame["obj"].alias("obj"), F.lit(False).alias("named"), F.lit(None).cast("string").alias("key"), members.cast(_MEMBERS).alias("m"))

    def step(acc, x):
        stack, depth = acc["stack"], F.size(acc["stack"])
        top = F.get(stack, depth - 1)
        opens, closes = x["t"].isin("{", "["), x["t"].isin("}", "]")
        name = top["obj"] & ~top["named"] & x["t"].startswith('"')
        fresh = F.struct((x["t"] == "{").alias("obj"), F.lit(False).alias("named"), F.lit(None).cast("string").alias("key"), F.array().cast(_MEMBERS).alias("m"))
        labelled = F.struct(top["obj"].alias("obj"), F.lit(True).alias("named"), x["plain"].alias("key"), top["m"].alias("m"))
        below = lambda n: F.slice(stack, 1, F.greatest(depth - n, F.lit(0)))
        value = F.when(closes, render(top, depth == 1)).otherwise(x["v"])
        into = F.when(closes, F.get(stack, depth - 2)).otherwise(top)
        kept = F.when(closes, below(2)).otherwise(below(1))
        last = into.isNull()
        after = (
            F.when(opens, F.concat(stack, F.array(fresh)))
            .when(F.coalesce(name, F.lit(False)), F.concat(below(1), F.array(labelled)))
            .when(last, F.array())
            .otherwise(F.concat(kept, F.array(put(into, value))))
        )
        return F.struct(after.cast(_STACK).alias("stack"), F.when(~opens & last, value).otherwise(acc["done"]).alias("done"))

    start = F.struct(F.array().cast(_STACK).alias("stack"), F.lit(None).cast("string").alias("done"))
    tokens = F.transform(F.regexp_extract_all(t, F.lit(TOKEN_RE), F.lit(0)), read)
    return F.when(_one_value(t), F.aggregate(tokens, start, step, lambda acc: acc["done"]))


def repair_json_text(c) -> Column:
    """P2 repair step: trim; unescape \\" \\n \\t once; quote bare keys."""
    t = pystrip(c)
    t = F.replace(t, F.lit('\\"'), F.lit('"'))
    t = F.replace(t, F.lit("\\n"), F.lit("\n"))
    t = F.replace(t, F.lit("\\t"), F.lit("\t"))
    return F.regexp_replace(t, r"([\{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":')


def json_with_repair(c, repair: bool = True) -> Column:
    """Parse as is; only when that fails and repair is on, parse the repaired text."""
    first = strict_json(c)
    if not repair:
        return first
    return F.coalesce(first, strict_json(repair_json_text(c)))


def undouble_quotes(c) -> Column:
    """Replace "" by " when the "" count exceeds half of the " count."""
    s = _col(c)
    doubled = (F.length(s) - F.length(F.replace(s, F.lit('""'), F.lit("")))) / 2
    single = F.length(s) - F.length(F.replace(s, F.lit('"'), F.lit("")))
    return F.when(doubled > F.floor(single / 2), F.replace(s, F.lit('""'), F.lit('"'))).otherwise(s)
