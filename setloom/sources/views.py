"""Domain views over the generated tables: tracks, cues, energy, transitions, candidates, clips, track lines, tempos.

The statements are valid in Spark and in other SQL engines alike. They run over whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from setloom.shipping import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_tracks": """
SELECT CAST(p_partkey AS BIGINT) AS track_id, concat('/lib/', p_brand, '/', p_name, ' ', CAST(p_partkey AS VARCHAR(20)), '.flac') AS file_path, p_name AS title,
 CAST(60 + p_size*8 AS DOUBLE) AS duration,
 90e0 + CAST((p_partkey*7919) % 9000 AS DOUBLE)/100e0 AS bpm,
 CAST((p_partkey*31) % 101 AS DOUBLE)/100e0 AS bpm_confidence,
 CAST((p_partkey*17) % 101 AS DOUBLE)/100e0 AS key_confidence,
 CAST((p_partkey % 12) AS BIGINT) AS root,
 CASE WHEN CAST(floor(p_partkey/12e0) AS BIGINT) % 2 = 0 THEN 'B' ELSE 'A' END AS mode,
 CAST((7*(p_partkey % 12) + CASE WHEN CAST(floor(p_partkey/12e0) AS BIGINT) % 2 = 0 THEN 7 ELSE 4 END) % 12 + 1 AS BIGINT) AS key_num,
 CAST(p_partkey % 40 AS BIGINT) AS n_downbeats,
 CAST(p_partkey % 5 AS BIGINT) AS n_in, CAST((p_partkey*3) % 7 AS BIGINT) AS n_out,
 CAST(p_partkey % 4 AS BIGINT) AS n_sections,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE -6e0 - CAST(p_partkey % 13 AS DOUBLE) END AS loudness,
 CAST((p_partkey*13) % 101 AS DOUBLE)/100e0 AS mean_energy,
 CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST((p_partkey*23) % 101 AS DOUBLE)/100e0 END AS beat_coverage,
 CAST(p_partkey % 3 AS BIGINT) AS n_phrase
FROM part""",
    "v_cues": """
SELECT CAST(vec_id % 50 AS BIGINT) AS track_id, CAST(floor(vec_id/50e0) AS BIGINT) AS pos,
 CASE WHEN CAST(floor(vec_id/50e0) AS BIGINT) % 2 = 0 THEN 'out' ELSE 'in' END AS type,
 10e0 + 20e0*floor(vec_id/50e0) + CAST(vec_id % 7 AS DOUBLE) AS ts,
 (vec_id % 3 = 0) AS phrase_aligned,
 CAST((vec_id*37) % 101 AS DOUBLE)/100e0 AS energy, CAST((vec_id*53) % 101 AS DOUBLE)/100e0 AS confidence,
 CASE WHEN vec_id % 17 = 0 THEN NULL ELSE embedding END AS embedding, CAST(vec_id AS BIGINT) AS cue_id
FROM embeddings""",
    "v_energy": """
SELECT user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS sec,
 value/(max(value) OVER (PARTITION BY user_id) + 1e-8) AS energy, value FROM events""",
    "v_transitions": """
SELECT mix_id, idx, k, announced_t, CASE WHEN k % 5 = 0 THEN 'rejected' ELSE 'ok' END AS status,
 CASE WHEN k % 5 <> 0 THEN NULL WHEN k % 15 = 0 THEN 'low_separability' WHEN k % 10 = 0 THEN NULL ELSE 'low_travel' END AS reject_reason,
 CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS is_cut,
 CASE WHEN k % 7 = 0 THEN 0e0 WHEN k % 19 = 0 THEN NULL ELSE CAST((k*29) % 260 AS DOUBLE)/4e0 END AS duration_bars,
 CAST((k*41) % 101 AS DOUBLE)/100e0 AS confidence,
 CASE k % 6 WHEN 0 THEN 0e0 WHEN 1 THEN 0.3e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 0.8e0 WHEN 4 THEN 1e0 ELSE NULL END AS camelot_score,
 CASE WHEN k % 9 = 0 THEN NULL ELSE genre END AS genre
FROM (SELECT CAST(o_custkey AS BIGINT) AS mix_id, CAST(o_orderkey AS BIGINT) AS k, o_orderpriority AS genre,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS idx,
  300e0*row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + CAST(o_orderkey % 60 AS DOUBLE) AS announced_t FROM orders) t""",
    "v_candidates": """
SELECT CAST(l_orderkey AS BIGINT) AS identifier, CAST(l_partkey % 10 AS BIGINT) AS stem_id, CAST(l_linenumber AS BIGINT) AS file_pos, CAST(l_partkey AS BIGINT) AS part_id, CAST(l_suppkey AS BIGINT) AS supp_id,
 CASE CAST(l_linenumber AS BIGINT) % 4 WHEN 0 THEN 'Flac' WHEN 1 THEN 'VBR MP3' WHEN 2 THEN 'Ogg Vorbis' ELSE 'JPEG' END AS format,
 CAST(l_quantity*20 AS DOUBLE) AS duration, CAST(floor(l_extendedprice) AS BIGINT) AS size,
 CASE WHEN l_suppkey % 6 = 0 THEN '' WHEN l_suppkey % 6 = 1 THEN 'http://creativecommons.org/publicdomain/zero/1.0/' ELSE 'http://creativecommons.org/licenses/by-nc-sa/3.0/' END AS license,
 CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST((l_partkey*37) % 101 AS DOUBLE)/100e0 END AS target_prob,
 60e0 + CAST((l_partkey*7919) % 20000 AS DOUBLE)/100e0 AS bpm,
 CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE concat('{"electronic": 0.', lpad(CAST((l_partkey*19) % 100 AS VARCHAR(20)), 2, '0'), ', "danceable": 0.', lpad(CAST((l_partkey*29) % 100 AS VARCHAR(20)), 2, '0'), ', "house": 0.', lpad(CAST((l_partkey*37) % 34 AS VARCHAR(20)), 2, '0'), ', "techno": 0.', lpad(CAST((l_partkey*41) % 33 AS VARCHAR(20)), 2, '0'), ', "trance": 0.', lpad(CAST((l_partkey*43) % 32 AS VARCHAR(20)), 2, '0'), '}') END AS highlevel,
 CASE WHEN l_partkey % 9 = 0 THEN 0e0 ELSE 60e0 + CAST((l_partkey*7919) % 20000 AS DOUBLE)/100e0 END AS measured_bpm,
 CASE WHEN l_suppkey % 5 = 0 THEN CAST(l_quantity*24 AS DOUBLE) ELSE CAST(l_quantity*20 AS DOUBLE) END AS measured_duration
FROM lineitem""",
    "v_clips": """
SELECT set_id, pos, track_id, s AS out_start, s + q + 8e0 AS out_end, 4e0 AS fade_in, 4e0 AS fade_out FROM (
 SELECT CAST(l_orderkey AS BIGINT) AS set_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS pos, CAST(l_partkey AS BIGINT) AS track_id, CAST(l_quantity AS DOUBLE) AS q,
 coalesce(sum(CAST(l_quantity AS DOUBLE)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS s FROM lineitem) t""",
    "v_tracklines": """
SELECT CAST(p_partkey AS BIGINT) AS line_id,
 CASE WHEN p_partkey % 13 = 0 THEN 'junk line' WHEN p_partkey % 17 = 0 THEN '# comment'
 ELSE concat(CASE WHEN p_partkey % 3 = 0 THEN '01. ' ELSE '' END, CASE WHEN p_partkey % 4 = 0 THEN '1:' ELSE '' END,
  lpad(CAST(p_partkey % 60 AS VARCHAR(20)),2,'0'), ':', lpad(CAST((p_partkey*7) % 60 AS VARCHAR(20)),2,'0'), ' ', p_brand, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE ' - ' END, p_name,
  CASE WHEN p_partkey % 6 = 0 THEN ' [deep house]' WHEN p_partkey % 7 = 0 THEN ' (2019 mix)' ELSE '' END) END AS raw FROM part""",
    "v_tempo_segments": """
SELECT CAST(c_custkey AS BIGINT) AS mix_id, CAST(g.i AS BIGINT) AS seg, 600e0*g.i AS seg_start, 600e0*(g.i+1) AS seg_end,
 120e0 + CAST((c_custkey*(g.i+3)) % 16 AS DOUBLE)/2e0 AS bpm FROM customer CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) g""",
}


def duck_view(name: str) -> str:
    return VIEWS[name].strip()


class Views:
    """The tables of a folder and the views over them, as DataFrames of a session."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        return self.sql(VIEWS[f"v_{name}"])

    def sql(self, text: str) -> DataFrame:
        """Runs a statement that names tables and views; they are bound to this folder, not to the session's catalog."""
        args: dict[str, DataFrame] = {}
        text = text.replace("{", "{{").replace("}", "}}")
        for name in sorted({*re.findall(r"\bv_\w+\b", text)} & set(VIEWS)):
            args[name] = self.sql(VIEWS[name])
        for name in TABLES:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                args[name] = self.table(name)
        for name in args:
            text = re.sub(rf"(\b(?:FROM|JOIN)\s+|,\s*){name}\b(?!\.)", rf"\1{{{name}}}", text)
        return self.spark.sql(text, **args) if args else self.spark.sql(text.replace("{{", "{").replace("}}", "}"))
