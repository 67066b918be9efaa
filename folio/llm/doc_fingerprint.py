"""Document fingerprints (threshold-scaled sketch): every shingle hash below a fixed fraction of all hashes is kept.

Words are split at the bytes 0x20 and 0x09-0x0D; shingles are 5 words joined by one space (fewer words: all of
them; none: no shingle), hashed by XXH64 with seed 0 as a set. The sketch is the sorted hashes below FRACTION * 2**64, and,
so that no text with a shingle has an empty one, the smallest hash. Its length follows the text's, so sketches of very
unequal documents compare: the share of one's hashes that another has estimates containment, and the union of two sketches
is the sketch of the two texts together (but for a smallest hash above the fraction).

A fingerprint is the sketch as text, 16 lowercase hex digits a hash. Equal texts have equal fingerprints. Likeness is the
Jaccard index of two sketches, from 0 to 1; two empty ones are alike (1).

Nulls: a null text is empty. Rows go by ascending doc_id, null last, rows that repeat a doc_id by their text; after the
last comes the first. Documents are dealt to ranges of doc_id; a range also gets the first row of the next one.
Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._common import parallelism, range_bounds, range_group, range_start, ship, utf8

SHINGLE, FRACTION = 5, 1 / 4


def sketch(text: bytes, size: int = SHINGLE, fraction: float = FRACTION) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles below the fraction, or else the smallest."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= size:
        return np.frombuffer(digest(whole), ">u8").astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    heads, tails = [0, *ends[:-size].tolist()], (ends[size - 1 :] - 1).tolist()
    limit, kept = np.uint64(int(fraction * (1 << 64)) - 1), []
    least = None
    for i in range(0, len(heads), 1 << 16):
        part = np.frombuffer(b"".join([digest(whole[a:b]) for a, b in zip(heads[i : i + (1 << 16)], tails[i : i + (1 << 16)], strict=True)]), ">u8").astype(np.uint64)
        least = part.min() if least is None else min(least, part.min())
        kept.append(part[part <= limit])
    found = np.unique(np.concatenate(kept))
    return found if len(found) else np.array([least], np.uint64)


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts together."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of a's shingles that b has; 1 for an empty a."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated Jaccard index."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many first code points of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_contained) of each
    row; next_contained is the estimated share of this text that the next document has."""
    ship(docs.sparkSession)
    bounds = range_bounds(docs, key, parallelism(docs))
    groups = max(len(bounds), 1)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = range_group(bounds, F.col("doc_id"))
    # a bound is the first doc_id of its range: its rows also go to the range before, as what follows there
    first = range_start(bounds, F.col("doc_id")) if bounds else F.lit(True)
    before = F.pmod(F.col("grp") - 1, F.lit(groups))
    dealt = rows.withColumn("grp", own).select("doc_id", "text", F.explode(F.when(first, F.array(F.struct(F.col("grp"), F.lit(False).alias("follows")), F.struct(before.alias("grp"), F.lit(True).alias("follows")))).otherwise(F.array(F.struct(F.col("grp"), F.lit(False).alias("follows"))))).alias("to"))
    dealt = dealt.select("doc_id", "text", "to.grp", "to.follows")

    def per_group(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("follows", "ascending"), ("doc_id", "ascending"), ("text", "ascending")], null_placement="at_end"))
        n = table.num_rows - pc.sum(table["follows"].cast(pa.int64())).as_py()
        texts = utf8(table["text"].slice(0, n + 1))
        chars, sha, own, other, near_own, near_next, contained = ([] for _ in range(7))
        value = texts[0].as_buffer().to_pybytes()
        mine = sketch(value, fraction=fraction)
        for i in range(n):
            after = texts[i + 1].as_buffer().to_pybytes()
            next_sketch = sketch(after, fraction=fraction)
            here = value.decode()
            changed = edited(here, after.decode()).encode()
            theirs = sketch(changed, fraction=fraction)
            chars.append(len(here))
            sha.append(hashlib.sha256(changed).hexdigest())
            own.append(as_text(mine))
            other.append(as_text(theirs))
            near_own.append(likeness(mine, theirs))
            near_next.append(likeness(mine, next_sketch))
            contained.append(containment(mine, next_sketch))
            value, mine = after, next_sketch
        columns = {"doc_id": table["doc_id"].slice(0, n), "n_chars": pa.array(chars, pa.int64()), "edited_sha256": pa.array(sha, pa.string()), "fingerprint": pa.array(own, pa.string()), "edited_fingerprint": pa.array(other, pa.string())}
        return pa.table(columns | {"near_edited": pa.array(near_own, pa.float64()), "near_next": pa.array(near_next, pa.float64()), "next_contained": pa.array(contained, pa.float64())})

    return dealt.groupBy("grp").applyInArrow(per_group, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_contained double")
