"""Decoding evaluation JSON into clean package records with content addresses."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.display import quoted
from catalith.operators.nested import _entries, _leaves, _utf8, parse

_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DEFAULT_SYSTEM = "x86_64-linux"

DECODED = pa.schema(
    [
        *((f, pa.string()) for f in ("attr_path", "name", "version", "system", "store_hash", "store_name", "meta_name", "meta_version", "program")),
        *((f, pa.string()) for f in ("summary", "description", "homepage", "license")),
        ("broken", pa.bool_()),
        ("insecure", pa.bool_()),
        ("platforms", pa.list_(pa.string())),
        ("outputs", pa.list_(pa.struct([("name", pa.string()), ("path", pa.string()), ("default", pa.bool_())]))),
        ("meta_hash", pa.string()),
        ("content_hash", pa.string()),
    ]
)


def canonical_json(value) -> str:
    """Keys sorted, no blanks, text as it is: equal values have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _clean(value) -> str:
    return unicodedata.normalize("NFD", value).strip(_SPACE) if isinstance(value, str) else ""


def _flat(value) -> list:
    return [] if value is None else [v for _, v in _leaves(value) if v is not None]


def _first_text(values: list) -> str:
    return next((v for v in values if isinstance(v, str) and v), "")


def _outputs(package: dict, meta: dict) -> list[dict]:
    """The default output, those that are installed, then the rest by name: a fixed order, as it is part of the content address."""
    left = {k: v if isinstance(v, str) else "" for k, v in package["outputs"].items()}
    main = package.get("outputName") if isinstance(package.get("outputName"), str) else ""
    first = [main] if main else []
    first += [n for n in _flat(meta.get("outputsToInstall")) if isinstance(n, str) and n != main]
    out = [{"name": n, "path": left.pop(n, ""), "default": True} for n in first]
    return out + [{"name": n, "path": left[n], "default": False} for n in sorted(left)]


def store_hash(path: str, prefix: str = "/nix/store/") -> str:
    path = path.removeprefix(prefix)
    return path[:32] if len(path) >= 32 else ""


def clean_package(attr_path: str, package: dict, hidden_field: str | None) -> dict:
    """One record of ``DECODED``; what is missing or of another type is "" or false.

    ``hidden_field`` is the field of ``meta`` that holds a version which the package's name doesn't; producers name it as they like, None for none.
    """
    meta = package.get("meta") if isinstance(package.get("meta"), dict) else {}
    licenses = _flat(meta.get("license"))
    spdx = _first_text([x.get("spdxId") for x in licenses if isinstance(x, dict)])
    outputs = _outputs(package, meta)
    name, version, hidden = (_clean(x) for x in (package.get("pname"), package.get("version"), meta.get(hidden_field) if hidden_field else None))
    if not version and hidden:
        version, name = hidden, name.removesuffix("-" + hidden)
    out = {
        "attr_path": _clean(attr_path),
        "name": name,
        "version": version,
        "system": _clean(package.get("system")) or DEFAULT_SYSTEM,
        "store_hash": store_hash(outputs[0]["path"]) if outputs else "",
        "store_name": name,
        "meta_name": _clean(meta.get("name")),
        "meta_version": _clean(meta.get("version")),
        "program": _clean(meta.get("mainProgram")),
        "summary": _clean(meta.get("description")),
        "description": _clean(meta.get("longDescription")),
        "homepage": _clean(_first_text(_flat(meta.get("homepage")))),
        "license": _clean(spdx or _first_text(licenses)),
        "broken": meta.get("broken") is True,
        "insecure": meta.get("insecure") is True,
        "platforms": sorted({_clean(p) for p in _flat(meta.get("platforms")) if isinstance(p, str)}),
        "outputs": outputs,
    }
    return out | _addresses(out | {"meta_version": [out["meta_version"]], "store_version": version})


def _addresses(package: dict) -> dict:
    """The hashes of a package's metadata and of its whole content; the fields and their names are fixed values, as equal contents must have equal hashes."""
    described = {k: package[k] for k in ("description", "homepage", "license", "platforms", "summary")}
    content = described | {k: package[k] for k in ("broken", "insecure", "outputs", "program")}
    content |= {"metaName": package["meta_name"], "metaVersion": package["meta_version"], "storeHash": package["store_hash"], "storeName": package["store_name"], "storeVersion": package["store_version"]}
    return {"meta_hash": sha256_hex(canonical_json(described)), "content_hash": sha256_hex(canonical_json(content))}


#: Text fields of a ``latest`` record that its content address covers.
LATEST_TEXTS = ["store_hash", "store_name", "store_version", "meta_name", "program", "summary", "description", "homepage", "license"]
LATEST = pa.schema([*((f, pa.string()) for f in ("attr_path", "system", "commit_hash", *LATEST_TEXTS)), ("broken", pa.bool_()), ("insecure", pa.bool_()), *((f, pa.list_(pa.string())) for f in ("meta_version", "platforms")), DECODED.field("outputs"), ("meta_hash", pa.string()), ("content_hash", pa.string())])


def latest_package(record: dict) -> dict:
    """One record of ``LATEST``: the content that an evaluation of the same package would have, with the same addresses.

    Texts stand as they are; what is missing or of another type is "", false or empty, a single value is an array of one; cache marks of outputs are dropped.
    """
    text = lambda x: x if isinstance(x, str) else ""
    out = {k: text(record.get(k)) for k in ("attr_path", "system", "commit_hash", *LATEST_TEXTS)}
    out |= {k: record.get(k) is True for k in ("broken", "insecure")}
    out |= {k: [v for v in _flat(record.get(k)) if isinstance(v, str)] for k in ("meta_version", "platforms")}
    out["outputs"] = [{"name": text(o.get("name")), "path": text(o.get("path")), "default": o.get("default") is True} for o in _flat(record.get("outputs")) if isinstance(o, dict)]
    return out | _addresses(out)


def _texts(record: dict) -> dict:
    return {k: _utf8([v])[0] if isinstance(v, str) else _utf8(v) if k in ("platforms", "meta_version") and isinstance(v, list) else v for k, v in record.items()}


def _decoded(records: DataFrame, wanted: str, schema: pa.Schema, package, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(raw_id, *carry, *schema)`` of ``package(path, object)`` for each package of the records of one shape; ``carry`` are text columns of theirs."""
    carried = [f"_{k}" for k in carry]  # their names may be those of decoded columns
    whole = pa.schema([("raw_id", pa.int64()), *((k, pa.string()) for k in carried), *schema])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw_id, shape, payload, *more in zip(*(batch.column(c).to_pylist() for c in range(3 + len(carry)))):
                if shape == wanted:
                    own = {"raw_id": raw_id} | dict(zip(carried, more))
                    rows += [own | _texts(package(path, found)) for path, found, _ in _entries(shape, parse(payload))]
            yield pa.RecordBatch.from_pylist(rows, whole)

    kinds = {pa.string(): "string", pa.bool_(): "boolean", DECODED.field("platforms").type: "array<string>", DECODED.field("outputs").type: "array<struct<name:string,path:string,default:boolean>>"}
    ddl = "raw_id long, " + ", ".join([*(f"{k} string" for k in carried), *(f"{f.name} {kinds[f.type]}" for f in schema)])
    return records.select(F.col("raw_id").cast("long").alias("raw_id"), "shape", "payload", *(F.col(k).cast("string").alias(a) for k, a in zip(carry, carried))).mapInArrow(decoded, ddl)


def decode_packages(records: DataFrame, hidden_field: str | None) -> DataFrame:
    """``(raw_id, *DECODED)``: one row for each package of the ``eval`` records ``(raw_id, shape, payload)``.

    Records whose payload is null, broken or no object give nothing, nor do entries that are no object or whose outputs are
    none. Repeated records give repeated rows.
    """
    return _decoded(records, "eval", DECODED, lambda path, package: clean_package(path, package, hidden_field))


def archive_packages(entries: DataFrame, hidden_field: str | None) -> DataFrame:
    """``DECODED`` of the entries ``(attr_path, package)`` that ``read_archives`` gives."""
    one = F.concat(F.lit("{"), quoted(F.col("attr_path")), F.lit(":"), F.col("package"), F.lit("}"))
    return decode_packages(entries.select(F.lit(None).cast("long").alias("raw_id"), F.lit("eval").alias("shape"), one.alias("payload")), hidden_field).drop("raw_id")


def decode_latest(records: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(raw_id, *carry, *LATEST)``: one row for each of the ``latest`` records ``(raw_id, shape, payload)``; broken payloads give nothing, repeated records repeated rows.

    ``carry`` are text columns of the records, which come out with a ``_`` before their names.
    """
    return _decoded(records, "latest", LATEST, lambda _, record: latest_package(record), carry)


# ---------------------------------------------------------------- archives


def stream_entries(chunks: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(key, JSON text) of each entry of the one object that ``chunks`` hold, without ever holding it whole.

    The wrapped form (a numeric ``version`` before ``packages``) gives the entries of ``packages``. Raises ``ValueError`` if the text is no
    complete object.
    """
    decoder, held, path = json.JSONDecoder(), "", []
    chunks = iter(chunks)

    def more() -> bool:
        nonlocal held
        part = next(chunks, None)
        held += part or ""
        return part is not None

    def peek() -> str:
        nonlocal held
        while True:
            held = held.lstrip(" \t\r\n")
            if held or not more():
                return held[:1]

    def take(mark: str) -> None:
        nonlocal held
        if peek() != mark:
            raise ValueError(f"expected {mark!r}")
        held = held[1:]

    def value() -> str:
        nonlocal held
        while True:
            held = held.lstrip(" \t\r\n")
            try:
                _, end = decoder.raw_decode(held)
                if end < len(held) or not more():  # a number may go on in the next chunk
                    out, held = held[:end], held[end:]
                    return out
            except ValueError:
                if not more():
                    raise

    take("{")
    path.append(None)
    wrapped = False
    while path:
        if peek() == "}":
            take("}")
            path.pop()
            if path and peek() == ",":
                take(",")
            continue
        key = json.loads(value())
        take(":")
        if len(path) == 1 and key == "version" and re.match(r"[-0-9]", peek()):
            value()
            wrapped = True
        elif len(path) == 1 and key == "packages" and wrapped and peek() == "{":
            take("{")
            path.append(key)
            continue
        else:
            yield key, value()
        if peek() == ",":
            take(",")
        elif peek() != "}":
            raise ValueError("the object isn't complete")


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, attr_path, package)`` of gzipped or plain evaluation archives, one task a file, streamed.

    The paths must lie in a folder that all executors share. Gzip can't be split, so the entries are spread afterwards by the next shuffle.
    """
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                open_ = gzip.open if path.endswith(".gz") else open
                with open_(path, "rt", encoding="utf-8") as f:
                    rows: list[tuple[str, str]] = []
                    for entry in stream_entries(iter(lambda: f.read(1 << 20), "")):
                        rows.append(entry)
                        if len(rows) == 1000:
                            yield _batch(path, rows)
                            rows = []
                    if rows:
                        yield _batch(path, rows)

    return files.mapInArrow(read, "path string, attr_path string, package string")


def _batch(path: str, rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, pa.string()) for c in zip(*rows))], names=["path", "attr_path", "package"])


__all__ = ["DECODED", "LATEST", "archive_packages", "canonical_json", "clean_package", "decode_latest", "decode_packages", "latest_package", "read_archives", "stream_entries"]
