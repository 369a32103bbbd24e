"""Results of every key when a few keys hold most rows: dense accumulators over equal input splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys a split keeps before it sends its blocks on and starts again.
SPLIT_KEYS = 200_000
#: Distinct keys of a block, on average at most: what one Python worker adds up in some 200 MB.
BLOCK_KEYS = 500_000

_PARTIAL = "block int, field string, keys array<string>, sums array<array<long>>"


def dense_sums(df: DataFrame, keys: dict[str, str], sums: list[str] | None = None, *, blocks: int | None = None, sized: DataFrame | None = None) -> DataFrame:
    """``(field, key_value, n, *sums)`` for every key of every field, over all rows.

    ``keys`` maps the name of a field to its key column, compared as a string, exactly; ``sums`` are integer columns to
    add up, null counting as 0; ``n`` counts rows. A null key belongs to no group, an empty string is a key.
    Repeated rows count each time: make copies one before. Empty tables give no rows.

    Rows are never shuffled by key. Each input split encodes its keys as codes of a dictionary of its own and scatters into
    dense arrays (``bincount``); it sends one entry a distinct key, cut into blocks by the key's hash. A block adds its arrays up in
    the same way, so a key of a third of all rows costs it one entry a split. The number of blocks follows the number of distinct keys, as
    estimated in one pass over ``sized``, a table with the same key columns that is cheaper to read (``df`` itself if not given).
    """
    sums = sums or []
    fields = list(keys)
    blocks = blocks or _blocks(df if sized is None else sized, list(keys.values()))
    rows = df.select(*(F.col(c).cast("string").alias(f"_k{i}") for i, c in enumerate(keys.values())), *(F.col(c).cast("long").alias(f"_s{j}") for j, c in enumerate(sums)))
    partial = rows.mapInArrow(_splits(fields, len(sums), blocks), _PARTIAL)
    named = "".join(f", s{j} long" for j in range(len(sums)))
    total = partial.groupBy("block").applyInArrow(_reduced(len(sums)), f"field string, key_value string, n long{named}")
    return total.select("field", "key_value", "n", *(F.col(f"s{j}").alias(c) for j, c in enumerate(sums)))


def _blocks(df: DataFrame, keys: list[str]) -> int:
    """Enough blocks for ``BLOCK_KEYS`` keys each, at least one for each shuffle partition and core."""
    sketch = [F.approx_count_distinct(k, 0.03).alias(k) for k in dict.fromkeys(keys)]
    known = sum(df.agg(*sketch).first())
    return max(2, -(-known // BLOCK_KEYS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _hash(keys: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys.to_pylist()), np.uint64, len(keys))


class _Accumulators:
    """Codes of the keys met so far and a dense array for each sum."""

    def __init__(self, n_sums: int):
        self.slot: dict[str, int] = {}
        self.sums = [np.zeros(1024, np.int64) for _ in range(n_sums + 1)]

    def add(self, keys: pa.Array, values: list[np.ndarray | None]) -> None:
        """Scatters ``values`` (None: ones) of the rows with these keys."""
        coded = keys.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        slot = self.slot
        slots = np.fromiter((slot.setdefault(w, len(slot)) for w in words), np.int64, len(words))
        if len(slot) > len(self.sums[0]):
            self.sums = [np.concatenate([a, np.zeros(max(len(a), len(slot) - len(a)), np.int64)]) for a in self.sums]
        for acc, v in zip(self.sums, values):
            if v is None:
                acc[slots] += np.bincount(codes, minlength=len(words))
            else:
                part = np.zeros(len(words), np.int64)
                np.add.at(part, codes, v)
                acc[slots] += part

    def blocks(self, field: str, n: int) -> Iterator[dict]:
        words = pa.array(list(self.slot), pa.string())
        block = (_hash(words) % np.uint64(n)).astype(np.int32)
        by = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[by], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(by)]):
            at = by[a:b]
            yield {"block": int(block[at[0]]), "field": field, "keys": words.take(pa.array(at)).to_pylist(), "sums": [s[at] for s in self.sums]}


def _splits(fields: list[str], n_sums: int, blocks: int):
    schema = pa.schema([("block", pa.int32()), ("field", pa.string()), ("keys", pa.list_(pa.string())), ("sums", pa.list_(pa.list_(pa.int64())))])

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Accumulators(n_sums) for _ in fields]

        def out(i: int) -> Iterator[pa.RecordBatch]:
            if held[i].slot:
                yield pa.RecordBatch.from_pylist(list(held[i].blocks(fields[i], blocks)), schema)
            held[i] = _Accumulators(n_sums)

        for batch in batches:
            for i in range(len(fields)):
                keys = batch.column(i)
                values = [batch.column(len(fields) + j).fill_null(0).to_numpy(zero_copy_only=False) for j in range(n_sums)]
                if keys.null_count:
                    there = keys.is_valid()
                    values = [v[there.to_numpy(zero_copy_only=False)] for v in values]
                    keys = pc.drop_null(keys)
                held[i].add(keys, [None, *values])
                if len(held[i].slot) > SPLIT_KEYS:
                    yield from out(i)
        for i in range(len(fields)):
            yield from out(i)

    return splits


def _reduced(n_sums: int):
    def reduced(table: pa.Table) -> pa.Table:
        parts = []
        for field in pc.unique(table["field"]).to_pylist():
            rows = table.filter(pc.equal(table["field"], field))
            acc = _Accumulators(n_sums)
            for chunk in rows.to_batches():
                for k in range(len(chunk)):
                    keys = chunk["keys"][k].values
                    acc.add(keys, [s.values.to_numpy(zero_copy_only=False) for s in chunk["sums"][k]])
            n = len(acc.slot)
            parts.append(pa.table({"field": pa.repeat(pa.scalar(field), n), "key_value": pa.array(list(acc.slot), pa.string()), "n": acc.sums[0][:n], **{f"s{j}": acc.sums[j + 1][:n] for j in range(n_sums)}}))
        return pa.concat_tables(parts)

    return reduced
