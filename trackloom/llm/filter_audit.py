"""How five document filters act in every order in which they can be applied.

A document is read once: its bytes are classed in Arrow's own buffers, running sums over the classes count words,
capitals and symbols, and the sorted hashes of its words tell how many are distinct. What is left of it is a mask of the
filters that it fails. Exact copies are found by a digest of the text, in counts of equal rows that are added up before
they are shuffled; the counts by part and mask then give all figures of all orders.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, finish, powers

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: In per cent: least distinct words, most capitals.
LEAST_DISTINCT, MOST_CAPITALS = 50, 3
SYMBOLS = b"#$%&*|"
#: White space between words.
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of words that are hashed at once.
BLOCK = 1 << 20
FACTOR = 0x9E3779B97F4A7C15
UP, DOWN = powers(FACTOR, BLOCK + 1), powers(pow(FACTOR, -1, 1 << 64), BLOCK + 1)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)


def class_of(members: bytes) -> np.ndarray:
    """Whether a byte is one of the members, for each of the 256."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


IS_BLANK, IS_SYMBOL, IS_CAPITAL = class_of(BLANKS), class_of(SYMBOLS), class_of(bytes(range(65, 91)))
#: Bytes that begin a code point.
IS_HEAD = ~class_of(bytes(range(0x80, 0xC0)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts and where each text begins and the last ends, without a copy. A null is empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each text, from running sums."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial of each word's bytes and its length, from running sums over blocks of whole words."""
    out, k = np.zeros(len(start), np.uint64), 0
    while k < len(start):
        stop = int(np.searchsorted(end, start[k] + BLOCK, "right"))
        if stop == k:  # a word that is longer than a block
            digest = hashlib.blake2b(raw[start[k] : end[k]], digest_size=8).digest()
            out[k], k = int.from_bytes(digest, "little"), k + 1
            continue
        low, high = start[k], end[stop - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * UP[: high - low], out=sums[1:])
        a, b = start[k:stop] - low, end[k:stop] - low
        out[k:stop] = finish((sums[b] - sums[a]) * DOWN[a] + (b - a).astype(np.uint64))
        k = stop
    return out


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether raw holds the same bytes from a on as from b on, for each pair of places; some pairs at once."""
    out = np.ones(len(a), bool)
    bounds = np.searchsorted(np.cumsum(size), np.arange(1, size.sum() // BLOCK + 2) * BLOCK, "left") + 1 if len(a) else []
    k = 0
    for stop in bounds:
        stop = min(int(stop), len(a))
        if stop <= k:
            continue
        own = size[k:stop]
        inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        unequal = raw[np.repeat(a[k:stop], own) + inside] != raw[np.repeat(b[k:stop], own) + inside]
        out[k + np.repeat(np.arange(stop - k), own)[unequal]] = False
        k = stop
    return out


def distinct_words(raw: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Distinct words of each text: its words' hashes are sorted, and neighbours of equal hash are compared by their bytes.
    A text in which two words share a hash is counted by its words themselves."""
    text = np.searchsorted(at, start, "right") - 1
    code = word_hashes(raw, start, end)
    order = np.argsort(code)
    order = order[np.argsort(text[order].astype(np.uint16) if len(at) < 1 << 16 else text[order], kind="stable")]
    one, two = order[:-1], order[1:]
    equal = (text[one] == text[two]) & (code[one] == code[two])
    one, two = one[equal], two[equal]
    size = end[one] - start[one]
    right = size == end[two] - start[two]
    right[right] = same_bytes(raw, start[one[right]], start[two[right]], size[right])
    count = np.bincount(text, minlength=len(at) - 1) - np.bincount(text[one], minlength=len(at) - 1)
    for k in np.unique(text[one[~right]]):
        count[k] = len({raw[a:b].tobytes() for a, b in zip(start[text == k], end[text == k], strict=True)})
    return count


def failures(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """For each text the mask of the filters A to D that it fails (A is bit 0) and a digest of its bytes."""
    raw, at = buffers(column)
    edge = np.zeros(len(raw) + 1, bool)
    inside = ~IS_BLANK[raw]
    edge[:-1] = inside
    edge[1:] ^= inside  # between a word and white space
    cuts = at[1:-1]
    # a word ends with its text, even if the next text goes on with a letter
    joined = np.unique(cuts[(cuts > 0) & (cuts < len(raw))])
    joined = joined[inside[joined - 1] & inside[joined]]
    bounds = np.sort(np.concatenate([np.flatnonzero(edge), joined, joined]))
    start, end = bounds[::2], bounds[1::2]
    words = np.bincount(np.searchsorted(at, start, "right") - 1, minlength=len(at) - 1)
    points = per_text(IS_HEAD[raw], at)
    capitals = per_text(IS_CAPITAL[raw], at)
    symbols = per_text(IS_SYMBOL[raw], at)
    distinct = distinct_words(raw, at, start, end)
    fails = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, symbols > 0]
    mask = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
    return mask, [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]


def scan(docs: DataFrame, *, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Rows (id, part, digest, mask) of all documents."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            mask, digest = failures(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(mask, pa.int32())], ["id", "part", "digest", "mask"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents by the filters that they fail, E (bit 4) included."""
    keys = ["digest", "mask", "part"]
    # equal rows are one from here on, so no id or text that is repeated often makes a large group
    alike = scan(docs, id_col=id_col, text_col=text_col, part_col=part_col).groupBy("id", *keys).agg(F.count("*").alias("n"))
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    told = alike.join(known, "id", "left").na.fill({"is_good": False, "is_toxic": False})
    keys += ["is_good", "is_toxic"]
    named = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    groups = told.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(named).alias("first"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    unique = F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0) + F.col("nameless")
    fails = groups.withColumn("unique", unique)
    rows = fails.select("part", "is_good", "is_toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("unique").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("unique")).alias("n")))).alias("x"))
    n = F.col("x.n")
    return rows.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("is_good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("is_toxic"), n).otherwise(0)).alias("toxic"))


def rules() -> dict[str, np.ndarray]:
    """For each figure, which masks of documents count in each step of each order: 600 rows of 32."""
    masks = np.arange(MASKS)
    own = np.array([1 << FILTERS.index(f) for o in ORDERS for f in o])[:, None]
    before = np.array([sum(1 << FILTERS.index(g) for g in o[:k]) for o in ORDERS for k in range(len(o))])[:, None]
    fails, gone = (masks & own) > 0, (masks & before) > 0
    return {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": np.broadcast_to(masks == own, fails.shape)}


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), one
    for each part, order of the five filters and step.

    A null text is empty, a null part the empty string. A document fails E if a smaller id has the same text; rows of one
    id and text fail or pass it together, and a row without an id passes, as none is smaller and it is smaller than none.
    A document counts as good or toxic if any of its label rows says so; labels without an id count for no document.
    Repeated rows count each; an empty table gives no rows. Other columns of docs and labels are not read."""
    order, step = [o for o in ORDERS for _ in o], [k + 1 for o in ORDERS for k in range(len(o))]
    letter = [f for o in ORDERS for f in o]
    # one row a part of 32 counts, however many documents there are
    counts = mask_counts(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col)
    table = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    figures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches):
        rule = {k: v.astype(np.int64) for k, v in rules().items()}
        own = np.array([FILTERS.index(f) for f in letter])
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, good, toxic = (np.zeros(MASKS, np.int64) for _ in range(3))
                for c in cells:
                    n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
                out = {k: v @ n for k, v in rule.items()}
                out |= {"good_lost": rule["removed"] @ good, "toxic_lost": rule["removed"] @ toxic}
                out["shapley"] = np.array([out["removed"][own == k].sum() for k in range(len(FILTERS))])[own]
                arrays = [pa.array([part] * len(order), pa.string()), pa.array(order), pa.array(step, pa.int32()), pa.array(letter), *(pa.array(out[f], pa.int64()) for f in figures)]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "filter_order", "step", "filter", *figures])

    return table.mapInArrow(run, "part string, filter_order string, step int, filter string, " + ", ".join(f"{f} long" for f in figures))
