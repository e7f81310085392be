"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in column expressions only.

A paragraph is a line; lines over 32 words are cut every 32 words. The digests of a text form a set. A sketch adds each digest
to one cell of each of three rows; a cell is one number that sums counts, digests and their check values. Sketches of two texts
subtract cell by cell; peeling cells that hold a single digest recovers the digests in which the texts differ. Where peeling gets
stuck, the digests are split by a hash into as many parts as needed, each with a sketch of its own, and again where a part
gets stuck; after the last retry the digests of such a part are compared directly.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, free_name, whole

ROWS, WIDTH = 3, 8
CELLS = ROWS * WIDTH
ROUNDS = 30
LOAD = 8  # digests that a part is planned for
WORDS = 32
DIGEST_BITS, CHECK_BITS = 30, 14
ONE = 1 << (DIGEST_BITS + CHECK_BITS)
SPAN = 1 << 62  # cells count modulo this, so that no text is too long for them
PARAGRAPH = rf"(?:{WORD}[\x20\x09\x0B\x0C]*){{1,{WORDS}}}"
RANGES = 4  # ranges of ids for the square root of each megabyte of text: both ranges and their size grow with its root


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an aggregate over nothing whose last step is the body. An expression used inside a
    lambda would be computed again for every element, and a transform would copy its result."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


def paragraphs(text: Column) -> Column:
    """The set of paragraph digests of a text, DIGEST_BITS of a hash each."""
    found = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(F.rtrim(p)).bitwiseAND(F.lit((1 << DIGEST_BITS) - 1))))


BITS = [1 << i for i in range(CELLS)]


def _bits() -> Column:
    return F.lit(BITS).cast("array<bigint>")


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1)).bitwiseAND(F.lit((1 << CHECK_BITS) - 1))


def _cells_of(digest: Column, seed: int) -> Column:
    """The set bits of the cells of a digest, one in each row."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.pmod(F.xxhash64(digest, F.lit(seed * ROWS + j)), F.lit(WIDTH)) + j * WIDTH).cast("int")) for j in range(ROWS)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def _code(digest: Column) -> Column:
    """What a digest adds to a cell: one in the count, the digest and its check value."""
    return F.shiftleft(digest, CHECK_BITS) + _check(digest) + F.lit(ONE)


def _digest(code: Column) -> Column:
    return F.shiftright(F.abs(code).bitwiseAND(F.lit(ONE - 1)), CHECK_BITS)


def sketch(digests: Column, seed: int = 0) -> Column:
    """Array of the sums of the codes in each cell, modulo SPAN."""
    return _let(
        F.transform(digests, lambda d: F.struct(_code(d).alias("c"), _cells_of(d, seed).alias("m"))),
        lambda placed: F.transform(_bits(), lambda bit: F.aggregate(placed, F.lit(0).cast("bigint"), lambda a, p: F.when(p["m"].bitwiseAND(bit) == 0, a).otherwise((a + p["c"]).bitwiseAND(F.lit(SPAN - 1))))),
    )


def subtract(left: Column, right: Column) -> Column:
    """Differences of the cells, between -SPAN / 2 and SPAN / 2: right where a cell differs by fewer than 131 072 digests. Others do not
    peel, as little as any cell that holds so many."""
    return F.zip_with(left, right, lambda a, b: (a - b + F.lit(SPAN // 2)).bitwiseAND(F.lit(SPAN - 1)) - F.lit(SPAN // 2))


def peel(cells: Column, seed: int = 0) -> Column:
    """Signed codes of the digests recovered from a subtracted sketch; null if peeling gets stuck.

    A cell holds a single digest if its count is one and the check value is right; a chance hit leaves cells that are not zero
    at the end and counts as stuck. A round takes the digests that are alone in a cell of one row, each of them once, off all
    rows; it ends when three rounds in turn, one for each row, have found none.
    """
    def pure(code: Column) -> Column:
        return (F.shiftright(F.abs(code), CHECK_BITS + DIGEST_BITS) == 1) & (F.abs(code).bitwiseAND(F.lit((1 << CHECK_BITS) - 1)) == _check(_digest(code)))

    def step(state: Column, turn: Column) -> Column:
        single = F.filter(F.slice(state["cells"], turn % ROWS * WIDTH + 1, F.lit(WIDTH)), pure)

        def without(codes: Column) -> Column:
            left = _let(F.transform(codes, lambda c: F.struct(c.alias("c"), _cells_of(_digest(c), seed).alias("m"))), lambda found: F.zip_with(
                state["cells"], _bits(), lambda c, bit: F.aggregate(found, c, lambda a, f: F.when(f["m"].bitwiseAND(bit) == 0, a).otherwise(a - f["c"]))))
            return F.struct(left.alias("cells"), F.concat(state["found"], codes).alias("found"), F.lit(0).alias("idle"))

        idle = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), (state["idle"] + 1).alias("idle"))
        return F.when(state["idle"] >= ROWS, state).otherwise(_let(single, lambda codes: F.when(F.size(codes) == 0, idle).otherwise(without(codes))))

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("found"), F.lit(0).alias("idle"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return _let(done, lambda s: F.when(F.forall(s["cells"], lambda c: c == 0), s["found"]))


def _attempt(left: Column, right: Column, seed: int) -> Column:
    return peel(subtract(sketch(left, seed), sketch(right, seed)), seed)


def _attempt_with(seed: int) -> Callable[[Column, Column], Column]:
    return lambda left, right: _attempt(left, right, seed)


def _split(digests: Column, first: Column, second: Column, seed: int) -> Column:
    """The digests in first * second parts, by two steps of a hash."""
    def part(values: Column, parts: Column, at: Column, salt: int) -> Column:
        return F.filter(values, lambda d: F.pmod(F.xxhash64(d, F.lit(1000 * salt + seed)), parts) == at)

    return F.flatten(F.transform(F.sequence(F.lit(0), first - 1), lambda a: _let(part(digests, first, a, 1), lambda some: F.transform(F.sequence(F.lit(0), second - 1), lambda b: part(some, second, b, 2)))))


def _in_parts(left: Column, right: Column, first: Column, second: Column, seed: int, solve: Callable[[Column, Column], Column]) -> Column:
    """Solutions of all parts together; null if one has none."""
    solved = F.zip_with(_split(left, first, second, seed), _split(right, first, second, seed), solve)
    return _let(solved, lambda parts: F.when(F.forall(parts, lambda p: p.isNotNull()), F.flatten(parts)))


def _compared(left: Column, right: Column) -> Column:
    """Signed codes of the digests that only one of two sets has, from the sets themselves."""
    return F.concat(F.transform(F.array_except(left, right), _code), F.transform(F.array_except(right, left), lambda d: -_code(d)))


def difference(left: Column, right: Column, sketches: tuple[Column, Column] | None = None) -> Column:
    """Digests that only one of two sets has, recovered from sketches as (n, k), n being 1 for the left set and -1 for the right one;
    with retries in more parts. A part whose last retry sticks is compared digest by digest, so there is always a result.

    ``sketches`` are those of the whole sets, if they are at hand.
    """
    def solve(a: Column, b: Column) -> Column:
        tries = [_attempt(a, b, 1)]
        tries += [_in_parts(a, b, F.lit(side), F.lit(side), seed, _attempt_with(seed)) for seed, side in ((2, 2), (3, 3), (4, 6), (5, 16))]
        return F.coalesce(*tries, _compared(a, b))

    whole_sets = peel(subtract(*sketches)) if sketches else _attempt(left, right, 0)
    parts = F.greatest(F.ceil((F.size(left) + F.size(right)) / LOAD).cast("int"), F.lit(2))
    first = F.ceil(F.sqrt(parts)).cast("int")
    codes = F.coalesce(whole_sets, _let(first, lambda n: _in_parts(left, right, n, F.ceil(parts / n).cast("int"), 1, solve)))
    return F.transform(codes, lambda c: F.struct(F.signum(c).cast("int").alias("n"), _digest(c).alias("k")))


def likeness(left: Column, right: Column, sketches: tuple[Column, Column] | None = None) -> Column:
    """Share of common digests among all digests of two texts, from the recovered difference; 1 for two texts without words."""
    total = (F.size(left) + F.size(right)).cast("double")
    return F.when(total == 0, 1.0).otherwise(_let(F.size(difference(left, right, sketches)), lambda d: (total - d) / (total + d)))


def serialized(cells: Column) -> Column:
    """Fingerprint: the sum of every cell in hexadecimal."""
    return F.array_join(F.transform(cells, lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")), "")


def with_next(docs: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """Adds next_<c> of the row that follows by falling key (then rising tie); after the last comes the first.

    Rows are dealt into RANGES * sqrt(megabytes) ranges of the key. Every range ends at a key that occurs, and the rows of
    that key are also dealt to the following range, so a row always finds its successor in its own range.
    """
    bounds = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.max(key).alias("high")).first()
    if bounds["high"] is None:
        return docs.withColumns({f"next_{c}": F.col(c) for c in columns})
    n = max(1, math.ceil(RANGES * math.sqrt((bounds["bytes"] or 0) / (1 << 20))))
    shares = [i / n for i in range(1, n)]
    inner = docs.agg(F.percentile_approx(key, shares, max(10_000, 20 * n)).alias("cuts")).first()["cuts"] if shares else []
    cuts = sorted({*inner, bounds["high"]})
    step = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    tops = F.array(*[F.lit(b[-1]).cast("bigint") for b in blocks])
    inside = F.array(*[F.array(*[F.lit(c).cast("bigint") for c in b]) for b in blocks])
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col(key)))
    part, ghost, spot = (free_name(docs, c) for c in ("_part", "_ghost", "_spot"))
    block = _let(below(tops), lambda b: _let(F.element_at(inside, b + 1), lambda cell: _let(below(cell), lambda i: F.struct((b * step + i).alias("i"), (F.element_at(cell, i + 1) == F.col(key)).alias("end")))))
    own = F.struct(F.col(spot)["i"].alias("i"), F.lit(False).alias("ghost"))
    after = F.struct(((F.col(spot)["i"] + 1) % len(cuts)).cast("int").alias("i"), F.lit(True).alias("ghost"))
    dealt = docs.withColumn(spot, block).withColumn(part, F.explode(F.when(F.col(spot)["end"], F.array(own, after)).otherwise(F.array(own))))
    dealt = dealt.withColumn(ghost, F.col(part)["ghost"]).withColumn(part, F.col(part)["i"])
    order = Window.partitionBy(part).orderBy(ghost, F.col(key).desc(), F.col(tie))
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter(~F.col(ghost))
    return out.select(*docs.columns, *[f"next_{c}" for c in columns])


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the beginning of the next document by falling doc_id instead of its own last half. Null texts count
    as empty, null ids come last, rows that share an id are ordered by a digest of the text. One document is its own next one.
    """
    lowest = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(lowest)).alias("key"), whole().alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "n_chars": F.char_length("text").cast("bigint"), "digests": paragraphs(F.col("text"))})
    paired = with_next(rows, "key", "tie", ["text", "digests"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    made = paired.select("doc_id", "n_chars", "digests", "next_digests", edited.alias("edited"))
    made = made.select("doc_id", "n_chars", "digests", "next_digests", F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("edited")).alias("edited_digests"))
    made = made.select("*", sketch(F.col("digests")).alias("own"), sketch(F.col("edited_digests")).alias("changed"))
    pair = lambda x, y, sx, sy: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), sx.alias("sa"), sy.alias("sb"))
    pairs = F.array(pair("digests", "edited_digests", F.col("own"), F.col("changed")), pair("digests", "next_digests", F.col("own"), sketch(F.col("next_digests"))))
    near = F.transform(pairs, lambda p: likeness(p["a"], p["b"], (p["sa"], p["sb"])))
    made = made.select("doc_id", "n_chars", "edited_sha256", serialized(F.col("own")).alias("fingerprint"), serialized(F.col("changed")).alias("edited_fingerprint"), near.alias("near"))
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("near")[0].alias("near_edited"), F.col("near")[1].alias("near_next"))
