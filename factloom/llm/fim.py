"""Fill-in-the-middle transformation by DuckDB inside mapInArrow.

Every Arrow batch is registered as a table of a DuckDB connection of the worker, one SQL statement cuts, draws and rearranges
its texts, and its Arrow result goes back to Spark: no Python code runs for a row. The stage has no shuffle and keeps no state, so
a lost executor costs its own partitions only; what is drawn depends on the seed and the row's id alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import chunks, text_or_empty

#: White space goes with the token after it; what trails at the end of a text is a token of its own.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Sentinels before prefix, suffix and middle; percent of texts that are transformed, and of these that put the suffix first.
PREFIX, SUFFIX, MIDDLE, RATE, SPM_RATE, SEED = "<P>", "<S>", "<M>", 50, 80, 42

SCHEMA = "id long, text string, n long, form string, prefix string, middle string, suffix string, output string, restored string, output_sha256 string, restored_sha256 string"
#: Bounds of DuckDB in a worker. It may not write to a local folder.
MEMORY = "1GB"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def statement(source: str = "batch", token: str = TOKEN, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED,
              marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> str:
    """SQL from `source` (id, text, both may be null) to the columns of SCHEMA, in any order of rows."""
    p, s, m = map(_quoted, marks)
    draws = ", ".join(f"('0x' || h[{8 * k + 1}:{8 * k + 8}])::BIGINT AS h{k + 1}" for k in range(4))
    clash = " OR ".join(f"contains(text, {x})" for x in (p, s, m))
    # an output is told apart at its sentinels: no part holds one, and none can arise where a part meets a sentinel
    after = lambda text, mark: f"substr({text}, strpos({text}, {mark}) + {{len}})"
    cut = lambda text, mark, n: after(text, mark).format(len=n)
    before = lambda text, mark: f"substr({text}, 1, strpos({text}, {mark}) - 1)"
    np_, ns, nm = map(len, marks)
    body_psm, body_spm = cut("output", p, np_), cut("output", s, ns)
    return f"""
WITH cut AS (SELECT id, text, regexp_extract_all(text, {_quoted(token)}) AS tokens, sha256('{seed}:' || coalesce(id::VARCHAR, '')) AS h FROM {source}),
drawn AS (SELECT id, text, tokens, len(tokens) AS n, {draws} FROM cut),
placed AS (SELECT id, text, tokens, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR {clash} OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT id, text, n, form,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, 1, a), '') END AS prefix,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, a + 1, b), '') END AS middle,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, b + 1, n), '') END AS suffix FROM placed),
made AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat({p}, prefix, {s}, suffix, {m}, middle) ELSE concat({s}, suffix, {p}, prefix, {m}, middle) END AS output FROM parts),
split AS (SELECT *, CASE form WHEN 'psm' THEN {before(body_psm, s)} WHEN 'spm' THEN {before(cut("output", p, np_), m)} END AS read_prefix,
  CASE form WHEN 'psm' THEN {before(cut("output", s, ns), m)} WHEN 'spm' THEN {before(body_spm, p)} END AS read_suffix,
  {cut("output", m, nm)} AS read_middle FROM made),
restored AS (SELECT *, CASE form WHEN 'plain' THEN output ELSE concat(read_prefix, read_middle, read_suffix) END AS restored FROM split)
SELECT id, text, n::BIGINT AS n, form, prefix, middle, suffix, output, restored, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM restored"""


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
                   columns: tuple[str, ...] = tuple(c.split()[0] for c in SCHEMA.split(", "))) -> DataFrame:
    """One row per document with those of SCHEMA's columns that are asked for: the text's tokens n; form (plain, psm: prefix, suffix, middle; spm:
    suffix, prefix, middle); the three parts (null if plain); the output with its sentinels; and the text restored from output and form.

    Null text counts as empty and stays plain, as does a text that holds a sentinel. Texts are cut whole, whatever their length. A null
    id draws as an empty one does; rows that repeat an id draw alike, each by its own number of tokens. Extra columns are
    ignored, whatever their names; an empty table gives an empty one.
    """
    kinds = dict(f.split() for f in SCHEMA.split(", "))
    sql = f"SELECT {', '.join(columns)} FROM ({statement(seed=seed, rate=rate, spm_rate=spm_rate)})"
    target = pa.schema([(c, pa.int64() if kinds[c] == "long" else pa.string()) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "autoinstall_known_extensions": False})
        for batch in batches:
            for part in chunks(batch, "text"):
                con.register("batch", pa.Table.from_batches([part]))
                out = con.sql(sql).to_arrow_table().cast(target)
                con.unregister("batch")
                yield from out.to_batches()
        con.close()
        pa.default_memory_pool().release_unused()

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))
