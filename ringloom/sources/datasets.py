"""Schemas of the tabular datasets, with readers that keep sentinels at the border."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.functions.scalar import unhex_text

SCHEMAS = {
    "batch_results": "file string, status string, match boolean, tokens long, multi long, elapsed_s double",
    "tie_dataset": "file string, tok_idx int, r int, cand_pos int, cand_len int, dist int, cand_idx_in_candidates int, is_chosen int, input_byte int, next_byte int, n_candidates int",
    "full_dataset": "filename string, token_index int, leaf_choice_index int, num_candidates int, max_candidate_len int, image_x int, image_y int, ring_r string, prev_token_kind string, min_distance int, min_distance_length int, leaf_choice_distance int, leaf_choice_length int",
    "tiebreaks": "file string, token_idx int, ring_r string, leaf_pos int, leaf_dist int, max_len int, n_max int, dists_csv string, leaf_dist_rank int",
    "hopeless": "file string, token_idx int, kind string, len int, leaf_pos string, leaf_dist string, leaf_rank string, n_tied string, leaf_tail string, tail_min string, tail_max string, actual_next string, tail_eq_fill string, tail_eq_next string",
    "gamma": "token_idx int, input_pos int, ring_r string, leaf_kind string, leaf_pos int, leaf_len int, n_legal int, legal_pos string",
    "oracle": "file string, total long, union_match long, hopeless long, first_hopeless string",
    "best_variant": "filename string, total_tokens long, best_variant string, best_match_count long, best_ratio double",
    "feasibility": "label string, feasible boolean",
    "encode_bench": "filename string, original_size long, reencoded_size long, binary_match boolean, first_diff_offset string, byte_diff_count long, payload_match boolean, payload_byte_diff long",
}


def read(spark: SparkSession, name: str, path: str, header: bool = True) -> DataFrame:
    """A dataset with its fixed schema; rows that are too short have nulls; ``-`` becomes null."""
    df = spark.read.csv(path, schema=SCHEMAS[name], sep=_separator(name), header=header, mode="PERMISSIVE", enforceSchema=True)
    return df.select(*[F.when(F.col(c) != "-", F.col(c)).alias(c) if kind == "string" and c not in ("file", "filename", "label") else F.col(c) for c, kind in df.dtypes])


def _separator(name: str) -> str:
    return "\t" if name in ("tiebreaks", "hopeless", "oracle") else ","


def write(df: DataFrame, name: str, path: str, header: bool = True) -> None:
    """A dataset in the order of its schema, as CSV or TSV files; null texts become ``-``."""
    columns = [x.split() for x in SCHEMAS[name].split(", ")]
    out = df.select(*[F.coalesce(F.col(c).cast(kind), F.lit("-")).alias(c) if kind == "string" else F.col(c).cast(kind) for c, kind in columns])
    out.write.csv(path, sep=_separator(name), header=header)


def write_json(df: DataFrame, path: str) -> None:
    """Each row as a JSON document; a frame of one row gives one file."""
    df.write.json(path)


def with_hex(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of hex text as numbers."""
    return df.withColumns({c: unhex_text(F.col(c)) for c in columns})


def with_lists(df: DataFrame, column: str, sep: str) -> DataFrame:
    """A column of joined numbers as an array."""
    return df.withColumn(column, F.transform(F.filter(F.split(column, sep), lambda x: x != ""), lambda x: x.cast("int")))


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """One name a line; blank lines don't count."""
    return spark.read.text(path).select(F.trim("value").alias("file")).where("file <> ''")


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)
