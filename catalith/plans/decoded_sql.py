"""SQL that decodes evaluation JSON: what ``decode_packages`` gives, stated in DuckDB's dialect."""

from __future__ import annotations

import unicodedata

_DECOMPOSED = {chr(n): unicodedata.normalize("NFD", chr(n)) for n in range(0xC0, 0x3000) if unicodedata.normalize("NFD", chr(n)) != chr(n)}
TABLE = f"MAP {{{', '.join(f'{a!r}: {b!r}' for a, b in _DECOMPOSED.items())}}}"
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def nfd(x: str) -> str:
    """Canonical decomposition letter by letter; several marks on one letter keep their order."""
    return f"CASE WHEN regexp_full_match({x}, '[\\x00-\\x7f]*') THEN {x} ELSE array_to_string(list_transform(string_split({x}, ''), lambda ch: coalesce(nfd_of[ch], ch)), '') END"


def clean(x: str) -> str:
    return f"coalesce(regexp_replace({nfd(x)}, '^{_SPACE}|{_SPACE}$', '', 'g'), '')"


def text(j: str, path: str) -> str:
    return f"CASE WHEN json_type({j}, '$.{path}') = 'VARCHAR' THEN {j} ->> '$.{path}' END"


#: Objects of all evaluations, payloads that are JSON texts of JSON unwrapped, wrapped ones by their packages.
ENTRIES = """
WITH RECURSIVE texts AS (
  SELECT DISTINCT raw_id, shape, payload AS j FROM raw_records
  UNION ALL SELECT raw_id, shape, j::json ->> '$' FROM texts WHERE CASE WHEN json_valid(j) THEN json_type(j) = 'VARCHAR' ELSE false END),
evals AS (
  SELECT raw_id, CASE WHEN json_type(j, '$.version') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_type(j, '$.packages') = 'OBJECT' THEN j::json -> '$.packages' ELSE j::json END AS j
  FROM texts WHERE shape = 'eval' AND CASE WHEN json_valid(j) THEN json_type(j) = 'OBJECT' ELSE false END),
listed AS (SELECT raw_id, unnest(json_keys(j)) AS attr_path, unnest(json_extract(j, '$.*')) AS p FROM evals),
entries AS (
  SELECT row_number() OVER () AS package, raw_id, attr_path, p, CASE WHEN json_type(p, '$.meta') = 'OBJECT' THEN p -> '$.meta' ELSE '{}'::json END AS meta
  FROM listed WHERE json_type(p) = 'OBJECT' AND json_type(p, '$.outputs') = 'OBJECT'),
walk AS (
  SELECT package, child, []::int[] AS place, meta -> ('$.' || child) AS j FROM entries, (VALUES ('license'), ('homepage'), ('platforms'), ('outputsToInstall')) c(child)
  UNION ALL SELECT package, child, list_append(place, k::int), j -> ('$[' || k || ']') FROM (SELECT *, unnest(range(json_array_length(j)::bigint)) AS k FROM walk WHERE json_type(j) = 'ARRAY')),
leaves AS (
  SELECT package, child, place, CASE WHEN json_type(j) = 'VARCHAR' THEN j ->> '$' END AS said, CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.spdxId') = 'VARCHAR' THEN j ->> '$.spdxId' END AS spdx FROM walk),
"""


def decoded_sql(hidden: str) -> str:
    quote = lambda x: f"to_json({x})::varchar"
    listed = lambda xs, one: f"'[' || array_to_string(list_transform({xs}, lambda x: {one}), ',') || ']'"
    described = [("description", quote("description")), ("homepage", quote("homepage")), ("license", quote("license")), ("platforms", listed("platforms", "to_json(x)::varchar")), ("summary", quote("summary"))]
    outputs = listed("outputs", "'{\"default\":' || x.d::varchar || ',\"name\":' || to_json(x.n)::varchar || ',\"path\":' || to_json(x.p)::varchar || '}'")
    content = [*described, ("broken", "broken::varchar"), ("insecure", "insecure::varchar"), ("outputs", outputs), ("program", quote("program")), ("metaName", quote("meta_name"))]
    content += [("metaVersion", f"'[' || {quote('meta_version')} || ']'"), ("storeHash", quote("store_hash")), ("storeName", quote("name")), ("storeVersion", quote("version"))]
    document = lambda parts: "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in sorted(parts)) + " || '}'"
    shown = listed("outputs", "'{\"name\":' || to_json(x.n)::varchar || ',\"path\":' || to_json(x.p)::varchar || ',\"default\":' || x.d::varchar || '}'")
    facts = {"summary": "description", "description": "longDescription", "meta_name": "name", "meta_version": "version", "program": "mainProgram"}
    return ENTRIES + f"""tables AS (SELECT {TABLE} AS nfd_of),
found AS (
  SELECT package, list(spdx ORDER BY place) FILTER (child = 'license' AND spdx <> '') AS ids, list(said ORDER BY place) FILTER (child = 'license' AND said <> '') AS licenses,
    list(said ORDER BY place) FILTER (child = 'homepage' AND said <> '') AS homepages, list(said ORDER BY place) FILTER (child = 'outputsToInstall' AND said IS NOT NULL) AS installed,
    list(said ORDER BY place) FILTER (child = 'platforms' AND said IS NOT NULL) AS systems FROM leaves GROUP BY 1),
named AS (
  SELECT package, {text('p', 'pname')} AS pname, {text('p', 'version')} AS said_version, {text('meta', hidden)} AS hidden, coalesce({text('p', 'outputName')}, '') AS main, json_keys(p, '$.outputs') AS keys,
    list_transform(json_extract(p -> '$.outputs', '$.*'), lambda v: CASE WHEN json_type(v) = 'VARCHAR' THEN v ->> '$' ELSE '' END) AS paths FROM entries),
firsts AS (SELECT *, CASE WHEN main = '' THEN [] ELSE [main] END || list_filter(coalesce(installed, []), lambda n: n <> main) AS first FROM named JOIN found USING (package)),
cleaned AS (
  SELECT package, {clean('pname')} AS name0, {clean('said_version')} AS version0, {clean('hidden')} AS hidden0,
    list_transform(first, lambda n, k: {{'n': n, 'p': CASE WHEN list_position(first, n) = k THEN coalesce(paths[list_position(keys, n)], '') ELSE '' END, 'd': true}})
      || list_transform(list_sort(list_filter(keys, lambda k: NOT list_contains(first, k))), lambda n: {{'n': n, 'p': paths[list_position(keys, n)], 'd': false}}) AS outputs,
    list_sort(list_distinct(list_transform(coalesce(systems, []), lambda s: {clean('s')}))) AS platforms,
    {clean('homepages[1]')} AS homepage, {clean('coalesce(ids[1], licenses[1])')} AS license FROM firsts, tables),
made AS (
  SELECT package, raw_id, {clean('attr_path')} AS attr_path, CASE WHEN version0 = '' AND hidden0 <> '' AND ends_with(name0, '-' || hidden0) THEN left(name0, length(name0) - length(hidden0) - 1) ELSE name0 END AS name,
    CASE WHEN version0 = '' THEN hidden0 ELSE version0 END AS version, coalesce(nullif({clean(text('p', 'system'))}, ''), 'x86_64-linux') AS system, outputs, platforms, homepage, license,
    {', '.join(f"{clean(text('meta', v))} AS {k}" for k, v in facts.items())}, coalesce(json_type(meta, '$.broken') = 'BOOLEAN' AND (meta ->> '$.broken') = 'true', false) AS broken,
    coalesce(json_type(meta, '$.insecure') = 'BOOLEAN' AND (meta ->> '$.insecure') = 'true', false) AS insecure,
    CASE WHEN starts_with(outputs[1].p, '/nix/store/') THEN substr(outputs[1].p, 12) ELSE coalesce(outputs[1].p, '') END AS bare FROM cleaned JOIN entries USING (package), tables),
hashed AS (SELECT *, CASE WHEN length(bare) >= 32 THEN left(bare, 32) ELSE '' END AS store_hash FROM made)
SELECT raw_id, attr_path, name, version, system, store_hash, name AS store_name, meta_name, meta_version, program, summary, description, homepage, license, broken, insecure,
  array_to_string(platforms, '|') AS platforms, {shown} AS outputs, sha256({document(described)}) AS meta_hash, sha256({document(content)}) AS content_hash FROM hashed"""


def latest_sql() -> str:
    texts = ["store_hash", "store_name", "store_version", "meta_name", "program", "summary", "description", "homepage", "license"]
    joined = lambda xs, one: f"'[' || array_to_string(list_transform({xs}, lambda x: {one}), ',') || ']'"
    outputs = joined("outs", "'{\"default\":' || x.d::varchar || ',\"name\":' || to_json(x.n)::varchar || ',\"path\":' || to_json(x.p)::varchar || '}'")
    said = {k: f"to_json({k})::varchar" for k in texts}
    described = {k: said[k] for k in ("description", "homepage", "license", "summary")} | {"platforms": joined("systems", "to_json(x)::varchar")}
    content = described | {"broken": "broken::varchar", "insecure": "insecure::varchar", "outputs": outputs, "program": said["program"], "metaName": said["meta_name"]}
    content |= {"metaVersion": joined("versions", "to_json(x)::varchar"), "storeHash": said["store_hash"], "storeName": said["store_name"], "storeVersion": said["store_version"]}
    document = lambda parts: "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in sorted(parts.items())) + " || '}'"
    flag = lambda k: f"coalesce(json_type(j, '$.{k}') = 'BOOLEAN' AND (j ->> '$.{k}') = 'true', false) AS {k}"
    return f"""
WITH RECURSIVE texts AS (
  SELECT DISTINCT raw_id, shape, payload AS j FROM raw_records
  UNION ALL SELECT raw_id, shape, j::json ->> '$' FROM texts WHERE CASE WHEN json_valid(j) THEN json_type(j) = 'VARCHAR' ELSE false END),
docs AS (SELECT row_number() OVER () AS doc, raw_id, j::json AS j FROM texts WHERE shape = 'latest' AND CASE WHEN json_valid(j) THEN json_type(j) = 'OBJECT' ELSE false END),
walk AS (
  SELECT doc, child, []::int[] AS place, j -> ('$.' || child) AS v FROM docs, (VALUES ('platforms'), ('meta_version'), ('outputs')) c(child)
  UNION ALL SELECT doc, child, list_append(place, k::int), v -> ('$[' || k || ']') FROM (SELECT *, unnest(range(json_array_length(v)::bigint)) AS k FROM walk WHERE json_type(v) = 'ARRAY')),
lists AS (
  SELECT doc, coalesce(list(v ->> '$' ORDER BY place) FILTER (child = 'platforms' AND json_type(v) = 'VARCHAR'), []) AS systems,
    coalesce(list(v ->> '$' ORDER BY place) FILTER (child = 'meta_version' AND json_type(v) = 'VARCHAR'), []) AS versions,
    coalesce(list({{'n': coalesce({text('v', 'name')}, ''), 'p': coalesce({text('v', 'path')}, ''), 'd': coalesce(json_type(v, '$.default') = 'BOOLEAN' AND (v ->> '$.default') = 'true', false)}} ORDER BY place)
      FILTER (child = 'outputs' AND json_type(v) = 'OBJECT'), []) AS outs FROM walk GROUP BY 1),
facts AS (SELECT raw_id, systems, versions, outs, {flag('broken')}, {flag('insecure')}, {', '.join(f"coalesce({text('j', k)}, '') AS {k}" for k in ("attr_path", "system", "commit_hash", *texts))} FROM docs JOIN lists USING (doc))
SELECT raw_id, attr_path, system, commit_hash, store_hash, summary, broken, insecure, array_to_string(versions, '|') AS meta_version, sha256({document(described)}) AS meta_hash, sha256({document(content)}) AS content_hash FROM facts"""
