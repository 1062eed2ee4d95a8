r"""Fill-in-the-middle: texts are cut into prefix, middle and suffix, and rearranged with markers.

DuckDB runs inside mapInArrow: each batch is registered as an Arrow table, one SQL statement cuts, draws and rearranges all
its rows, and the result leaves as Arrow batches.  No row is touched by Python.

A text is n tokens `[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+`, which together are the whole text.  Where it is cut and
how it is arranged comes from sha256 of seed and doc_id alone, so a task that runs again gives the same rows.

Scale: one map over the scan, no shuffle, nothing broadcast.  Batches are bounded by bytes and cut further into slices of
about SLICE_BYTES, each a statement of its own, so a task holds the token lists of one slice.  DuckDB has one thread, as Spark
deals the work, and no folder to spill to.

Edge cases: a null text is an empty one, which stays plain with n = 0; a null doc_id draws as the empty string; repeated rows
give equal rows; an empty table gives an empty one; columns of docs whose names the result needs for itself are kept by
`with_middles` under their own names, the new columns come under `fim_` names.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, map_arrow, slices

#: Fixed values of the contract.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_FROM, SPM_BELOW = "42", 50, 80

SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, restored string, output_sha256 string, restored_sha256 string"


def statement(source: str, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> str:
    """SQL over `source` (row, doc_id, text): one row for each of its rows, in SCHEMA's columns.

    The text is rebuilt from output and form: markers stand once each, as a text that holds one stays plain and no piece's end
    and marker make another marker.
    """
    draw = lambda k: f"('0x' || substr(digest, {8 * k - 7}, 8))::BIGINT"
    at = lambda mark: f"strpos(output, '{mark}')"
    rest = f"substr(output, {at(MIDDLE)} + {len(MIDDLE)})"
    between = lambda a, b: f"substr(output, {at(a)} + {len(a)}, {at(b)} - {at(a)} - {len(a)})"
    return rf"""
WITH cut AS (
  SELECT row, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS tokens,
         sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM {source}),
drawn AS (
  SELECT row, text, tokens, len(tokens) AS n, {draw(1)} % (len(tokens) + 1) AS x, {draw(2)} % (len(tokens) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {draw(3)} % 100 >= {plain_from} THEN 'plain'
              WHEN {draw(4)} % 100 < {spm_below} THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT row, text, n, form,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, 1, least(x, y)), '') END AS prefix,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, least(x, y) + 1, greatest(x, y)), '') END AS middle,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, greatest(x, y) + 1, n), '') END AS suffix FROM drawn),
made AS (
  SELECT row, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
         CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                   ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM parts),
back AS (
  SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {between(PREFIX, SUFFIX)} || {rest} || {between(SUFFIX, MIDDLE)}
                      ELSE {between(PREFIX, MIDDLE)} || {rest} || {between(SUFFIX, PREFIX)} END AS restored FROM made)
SELECT n::BIGINT AS n, form, prefix_chars::BIGINT AS prefix_chars, middle_chars::BIGINT AS middle_chars, output, restored,
       sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM back ORDER BY row"""


def with_middles(docs: DataFrame, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, texts: bool = True) -> DataFrame:
    """docs with fim_n, fim_form, fim_prefix_chars, fim_middle_chars, fim_output, fim_restored and two digests.

    With texts=False the two texts stay behind, and only their digests leave DuckDB.
    """
    if not set(seed) <= set("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-"):
        raise ValueError("a seed of letters, digits, - and _")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    wanted = [c for c in names if texts or c not in ("output", "restored")]
    clash = {f"fim_{c}" for c in wanted} & set(docs.columns)
    if clash:
        raise ValueError(f"docs already has {sorted(clash)}")
    carried = [c for c in docs.columns if texts or c != "text"]
    rows = docs.select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_own"))
    sql = f"SELECT {', '.join(wanted)} FROM ({statement('batch', seed, plain_from, spm_below)})"

    def run(batches):
        with duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True}) as db:
            for batch in batches:
                for part in slices(batch, "_text", SLICE_BYTES):
                    table = pa.table({"row": pa.array(range(part.num_rows), pa.int64()), "doc_id": part.column("_key"), "text": part.column("_text")})
                    db.register("batch", table)
                    made = db.sql(sql).to_arrow_table()
                    db.unregister("batch")
                    columns = [c.combine_chunks() for c in made.columns]
                    yield pa.RecordBatch.from_arrays([part.column("_own"), *columns], names=["_own", *(f"fim_{c}" for c in wanted)])

    schema = f"_own {rows.schema['_own'].dataType.simpleString()}, " + ", ".join(f"fim_{c}" for c in SCHEMA.split(", ") if c.split()[0] in wanted)
    return map_arrow(rows, run, schema).select("_own.*", *(f"fim_{c}" for c in wanted))


def op12_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = with_middles(docs, texts=False)
    names = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    return made.select("doc_id", *(F.col(f"fim_{c}").alias(c) for c in names))


#: The same rows by places in the text instead of lists: where tokens end, then substrings.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
k AS (SELECT doc_id, text, h, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM t),
e AS (SELECT doc_id, text, h, len(u) AS n, list_transform(u, lambda x: length(x)) AS sizes,
             ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2 FROM k),
p AS (SELECT *, coalesce(list_sum(sizes[1:least(c1, c2)]), 0)::BIGINT AS a, coalesce(list_sum(sizes[1:greatest(c1, c2)]), 0)::BIGINT AS b,
             CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
                        ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""
