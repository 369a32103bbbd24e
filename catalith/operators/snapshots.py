"""What consecutive full snapshots added, removed or changed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Compact rows (about 40 bytes) that one bucket holds at most on average.
BUCKET_ROWS = 200_000
CHANGES = np.array(["added", "removed", "changed"], dtype=object)


def _hashed(cols: list[str], salt: int):
    """64 bits of the key; a null differs from every string."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]
    return F.xxhash64(F.lit(salt), *(parts if salt else reversed(parts)))


def snapshot_changes(
    members: DataFrame,
    contents: DataFrame,
    *,
    scope: str,
    seq: str,
    key: list[str],
    content: str,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``(scope, seq, *key, change)`` of each key that differs from the snapshot before.

    ``members`` lists the keys of each snapshot ``(scope, seq)``, ``contents`` the content of keys, some of which may belong to no
    snapshot. Consecutive snapshots are neighbours by ``seq`` within a scope; the first has no rows. Contents are
    compared without regard to letter case; null is a content of its own; keys are compared exactly, null equals null.
    Copies count once; of several contents of one key one is taken, always the same. Rows with a null scope
    or seq belong to no snapshot. Empty tables give no rows.

    Both tables shrink to 128-bit key hashes and 64-bit content hashes, combined before the shuffle. Buckets of the
    key hash hold all snapshots of their keys as sorted numpy arrays; ``searchsorted`` gives the differences, and
    only keys that differ get their values back.
    """
    real = F.col(scope).isNotNull() & F.col(seq).isNotNull()
    members = members.where(real).select(scope, seq, *key)
    compact = [F.col(scope).alias("_scope"), F.col(seq).alias("_seq"), _hashed(key, 0).alias("_k1"), _hashed(key, 1).alias("_k2")]
    listed = members.select(*compact, F.lit(True).alias("_in"), F.lit(None).cast("long").alias("_row"))
    hashed = F.when(F.col(content).isNotNull(), F.xxhash64(F.lower(F.col(content))))
    held = contents.where(real).select(*compact, F.lit(False).alias("_in"), hashed.alias("_row"))
    rows = listed.unionByName(held).groupBy("_scope", "_seq", "_k1", "_k2").agg(F.max("_in").alias("_in"), F.max("_row").alias("_row"))
    rows = rows.where("_in").drop("_in")

    order: dict = {}
    for r in members.select(scope, seq).distinct().collect():  # one row a snapshot
        order.setdefault(r[0], []).append(r[1])
    order = {k: sorted(v) for k, v in order.items()}
    buckets = max(1, -(-members.count() // bucket_rows))

    schema = f"_scope {dict(members.dtypes)[scope]}, _seq {dict(members.dtypes)[seq]}, _k1 long, _k2 long, change string"
    rows = rows.withColumn("_bucket", F.pmod(F.col("_k1"), F.lit(buckets)))
    changes = rows.groupBy("_scope", "_bucket").applyInArrow(_differences(order), schema)
    values = members.select(*key).distinct().select(*key, _hashed(key, 0).alias("_k1"), _hashed(key, 1).alias("_k2"))
    out = changes.join(values, ["_k1", "_k2"])
    return out.select(F.col("_scope").alias(scope), F.col("_seq").alias(seq), *key, "change")


def _differences(order: dict):
    def differences(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        scope = table["_scope"][0].as_py()
        seqs, k1, k2 = (table[c].to_numpy() for c in ("_seq", "_k1", "_k2"))
        row = table["_row"].fill_null(0).to_numpy()
        known = table["_row"].is_valid().to_numpy()
        by = np.lexsort((k2, k1))
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(k1[by]) != 0) | (np.diff(k2[by]) != 0)
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(new) - 1  # the dense rank of the key
        heads = by[new]
        snaps = order[scope]
        cut = np.argsort(seqs, kind="stable")
        edges = np.searchsorted(seqs[cut], snaps, "left"), np.searchsorted(seqs[cut], snaps, "right")
        out_seq, out_key, out_kind = [], [], []
        before = None
        for s, a, b in zip(snaps, *edges):
            now = cut[a:b]
            now = now[np.argsort(place[now], kind="stable")]
            if before is not None:
                was, has = place[before], place[now]
                at = np.searchsorted(was, has)
                same = np.zeros(len(has), bool)
                inside = at < len(was)
                same[inside] = was[at[inside]] == has[inside]
                there = np.searchsorted(has, was)
                gone = np.ones(len(was), bool)
                inside = there < len(has)
                gone[inside] = has[there[inside]] != was[inside]
                old, cur = before[at[same]], now[same]
                differs = (row[old] != row[cur]) | (known[old] != known[cur])
                for kind, keys in enumerate((has[~same], was[gone], has[same][differs])):
                    out_seq.append(np.full(len(keys), s, seqs.dtype))
                    out_key.append(keys)
                    out_kind.append(np.full(len(keys), kind))
            before = now
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        keys, kinds = heads[cat(out_key, np.int64)], cat(out_kind, np.int64)
        return pa.table(
            {
                "_scope": pa.repeat(table["_scope"][0], len(keys)),
                "_seq": pa.array(cat(out_seq, seqs.dtype)),
                "_k1": pa.array(k1[keys]),
                "_k2": pa.array(k2[keys]),
                "change": pa.array(CHANGES[kinds], pa.string()),
            }
        )

    return differences


def imported_only(rows: DataFrame, imports: DataFrame, on: list[str], small: int = 500_000) -> DataFrame:
    """Rows whose ``on`` columns some import has; the imports are broadcast only when counted small."""
    imports = imports.select(*on).distinct()
    return rows.join(F.broadcast(imports) if imports.count() <= small else imports, on, "left_semi")


__all__ = ["snapshot_changes", "imported_only"]
