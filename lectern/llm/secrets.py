"""Secret scans: known formats, and sliding-window Shannon entropy, with DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three kinds (assign, access, hex); a
match that is too short is dropped after it has taken its place. The entropy scan adds spans of
two kinds: for each character class, candidate strings are its runs of at least WINDOW
characters; a window slides over them, the counts of its characters are updated by the one that
enters and the one that leaves, and with them the sum of k log2 k, from which the window's
entropy follows. The span goes from the first to the last window at or above the class's limit.
Candidates that match the allow-list, or lack what the class requires, are passed over; base
spans are never suppressed.

Offsets are code points, ends are exclusive. A null text counts as empty and has no spans. Rows,
also repeated ones, are judged one by one; columns other than the text aren't looked at, and an
input column that has the name of an output column is replaced. The work grows with the length of a
text and of its candidates; patterns have no repeated groups, which would need stack for long ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # the same matches as AKIA[A-Z0-9]+ of 20 or more characters
HEX = "[0-9a-f]{24,}"  # likewise
LEAST_VALUE = 6

WINDOW = 24
#: Kind -> symbols, candidate pattern, what a candidate must have, least entropy of a window in bits.
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", f"[0-9A-Fa-f]{{{WINDOW},}}", ("[A-Fa-f]",), 3.0),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", f"[A-Za-z0-9+/_-]{{{WINDOW},}}", ("[0-9]", "[A-Za-z]"), 4.0),
}


class Allow(NamedTuple):
    """A candidate is no secret if every pattern of the first kind finds something in it, and none of the second."""

    every: tuple[str, ...]
    none: tuple[str, ...] = ()


#: UUIDs, alphabets in order, placeholders, paths (parts of letters with few digits behind them, a short last part).
ALLOWED = (
    Allow(("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",)),
    Allow(("(?i)0123456789abcdef|abcdefghijklmnop",)),
    Allow(("(?i)example|placeholder|dummy|sample",)),
    Allow(("/[A-Za-z0-9_-]{0,23}$", "^/?[A-Za-z_-]+[0-9]{0,4}/"), ("[+]|//", "/[0-9][^/]*/", "[0-9][A-Za-z_-][^/]*/", "[0-9]{5}[^/]*/")),
)

_SPAN = "struct<start:int,kind:int,end:int>"
#: Results of a fold are gathered in blocks of so many, so that long lists aren't copied again and again.
_BLOCK = 256


def _gathered(parts: Column, start: dict[str, Column], kind: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column, Column]], last: Callable[[Column], Column] | None = None) -> Column:
    """array<kind>: folds over parts; step gives the new state, whether it adds an element, and which."""
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def move(s: Column, part: Column) -> Column:
        state, adds, element = step(s, part)
        block = F.concat(s["block"], F.array(element))
        full = adds & (F.size(s["block"]) == _BLOCK - 1)
        return F.struct(
            *(v.alias(k) for k, v in state.items()),
            F.when(full, none).when(adds, block).otherwise(s["block"]).alias("block"),
            F.when(full, F.concat(s["out"], F.array(block))).otherwise(s["out"]).alias("out"),
        )

    def finish(s: Column) -> Column:
        ended = [F.array(last(s))] if last else []
        return F.flatten(F.concat(s["out"], F.array(F.concat(s["block"], *ended))))

    return F.aggregate(parts, F.struct(*(v.alias(k) for k, v in start.items()), none.alias("block"), nothing.alias("out")), move, finish)


def spans(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0, with_text: bool = False) -> Column:
    """array<struct<start,kind,end>>, with the match's text if asked for, of the pattern's matches whose group has at least so many characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("text"), value.alias("value"))
    kind = _SPAN.replace("end:int", "end:int,text:string") if with_text else _SPAN

    def step(s: Column, part: Column) -> tuple[dict[str, Column], Column, Column]:
        start = s["at"] + part["gap"]
        end = start + F.length(part["text"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("kind"), end.alias("end"), *([part["text"].alias("text")] if with_text else []))
        return {"at": end}, F.length(part["value"]) >= least, span

    return F.when(text.rlike(pattern), _gathered(parts, {"at": F.lit(0)}, kind, step)).otherwise(F.array().cast(f"array<{kind}>"))


def _hot_part(candidate: Column, symbols: str, limit: float, window: int) -> Column:
    """struct<first,last>: ends of the first and last window at or above the limit; null first if there is none."""
    folded = symbols if len(symbols) > 22 else symbols[:16]
    chars = F.split(candidate if folded is symbols else F.lower(candidate), "")
    at = F.transform(F.slice(chars, 1, F.length(candidate)), lambda c: F.instr(F.lit(folded), c))
    weight = F.array(*(F.lit(k * math.log2(k) if k else 0.0) for k in range(window + 2)))
    most = window * (math.log2(window) - limit) + 1e-9  # the entropy is log2(window) - sum / window
    moves = F.arrays_zip(at.alias("enter"), F.slice(F.concat(F.array_repeat(F.lit(0), window), at), F.lit(1), F.length(candidate)).alias("leave"))

    def step(s: Column, m: Column) -> Column:
        end = s["end"] + 1
        entered = F.get(s["counts"], m["enter"] - 1)
        left = F.when(m["leave"] > 0, F.get(s["counts"], m["leave"] - 1) + (m["leave"] == m["enter"]).cast("int")).otherwise(1)
        total = s["sum"] + F.get(weight, entered + 1) - F.get(weight, entered) + F.get(weight, left - 1) - F.get(weight, left)
        counts = F.transform(s["counts"], lambda k, i: k + (i == m["enter"] - 1).cast("int") - (i == m["leave"] - 1).cast("int"))
        hot = (end >= window) & (total <= most)
        return F.struct(
            end.alias("end"),
            counts.alias("counts"),
            total.alias("sum"),
            F.when(hot & s["first"].isNull(), end).otherwise(s["first"]).alias("first"),
            F.when(hot, end).otherwise(s["last"]).alias("last"),
        )

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("end"), F.array_repeat(F.lit(0), len(folded)).alias("counts"), F.lit(0.0).alias("sum"), none.alias("first"), none.alias("last"))
    return F.aggregate(moves, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _entropy_spans(text: Column, kind: str, allowed: tuple[Allow, ...], window: int = WINDOW) -> Column:
    symbols, pattern, needs, limit = CLASSES[kind]
    rank = KINDS.index(kind)

    def judge(span: Column) -> Column:
        candidate = span["text"]
        wanted = reduce(and_, [candidate.rlike(p) for p in needs])
        for allow in allowed:
            finds = [candidate.rlike(p) for p in allow.every] + [~candidate.rlike(p) for p in allow.none]
            wanted = wanted & ~reduce(and_, finds)
        part = F.when(wanted, _hot_part(candidate, symbols, limit, window))
        return F.struct((span["start"] + part["first"] - window).alias("start"), F.lit(rank).alias("kind"), (span["start"] + part["last"]).alias("end"))

    judged = F.transform(spans(text, pattern, rank, with_text=True), judge)
    return F.filter(judged, lambda span: span["start"].isNotNull())


def find(df: DataFrame, text: str = "text", allowed: tuple[Allow, ...] = ALLOWED) -> DataFrame:
    """df with columns assign, access, hex and entropy: arrays of struct<start,kind,end>, kind an index of KINDS."""
    value = F.coalesce(F.col(text), F.lit(""))
    assign = spans(value, ASSIGN, 0, group=2, least=LEAST_VALUE)
    entropy = F.concat(*(_entropy_spans(value, kind, allowed) for kind in CLASSES))
    return df.withColumns({"assign": assign, "access": spans(value, ACCESS, 1), "hex": spans(value, HEX, 2), "entropy": entropy})


def listing(*columns: str) -> Column:
    """The spans in these columns as kind:start:end, by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.concat(*(F.col(s) for s in columns)))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", allowed: tuple[Allow, ...] = ALLOWED) -> DataFrame:
    """df with each secret of the text, overlapping ones as one, replaced by the mark; null texts stay null."""
    columns = df.columns
    found = find(df.select(F.struct(*columns).alias("_row"), F.col(text).alias("_text")), "_text", allowed)
    listed = F.array_sort(F.concat("assign", "access", "hex", "entropy"))
    found = found.select("_row", "_text", listed.alias("_spans"))
    chars = F.when(F.size("_spans") > 0, F.split("_text", ""))
    # a generator, so that the characters of a text are laid out once
    found = found.select("_row", F.inline(F.array(F.struct("_text", "_spans", chars.alias("_chars")))))
    gap = lambda a, b: F.struct((a + 1).alias("begin"), (b - a).alias("long"))

    def step(s: Column, span: Column) -> tuple[dict[str, Column], Column, Column]:
        return {"at": F.greatest(s["at"], span["end"])}, span["start"] >= s["at"], gap(s["at"], span["start"])

    gaps = _gathered(F.col("_spans"), {"at": F.lit(0)}, "struct<begin:int,long:int>", step, lambda s: gap(s["at"], F.length("_text")))
    kept = F.array_join(F.transform(gaps, lambda g: F.array_join(F.slice(F.col("_chars"), g["begin"], g["long"]), "")), mark)
    cleaned = F.when(F.size("_spans") > 0, kept).otherwise(F.col("_text"))
    return found.select(*(cleaned.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in columns))
