"""End-to-end jobs (C1, C2): identifiers in, reports out.

A job classifies the identifiers once and writes the classified table into
the shared folder (``spark.checkpoint.dir``). The valid and rejected
branches, the key counts and the join back all read that written table, so
the classification is not recomputed per branch and a lost executor costs
a re-read, not a re-run of the upstream plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import fixed

from ..operators.providers import Provider
from ..operators.resolve import (DEFAULT_ROWS_PER_SPLIT, ROW, attach, key_counts, read_numbered, resolve_keys_in_turn,
                                 resolve_keys_with_lookup)
from ..operators.summary import summary_distinct, summary_rows
from ..operators.validate import classify, rejected_ids, valid_ids
from ..session import remove_path, scratch_path
from . import grid as G
from . import report as P

FORMATS = ("text", "json", "csv")


@dataclass
class JobResult:
    results: DataFrame        # one row per valid input row
    rejected: DataFrame       # invalid input rows with the reason
    summary: DataFrame        # A1 totals (rows)
    summary_keys: DataFrame   # A2 totals (distinct failed keys)
    work_dir: str
    input_counts: dict        # A3: rows_read, rows_valid (observed while writing)
    valid: DataFrame          # the classified valid rows
    keys: DataFrame           # their distinct keys with counts, provider, meta and error

    def close(self) -> None:
        """Remove the job's working tables; its frames can't be read after that."""
        remove_path(self.results.sparkSession, self.work_dir)


def run_resolve(spark: SparkSession, ids: DataFrame, providers: list[Provider] | None = None, raw: str = "raw",
                rows_per_split: int = DEFAULT_ROWS_PER_SPLIT,
                require_input: bool = False, lookup: DataFrame | None = None) -> JobResult:
    """C1 core: classify once (written), then resolve, keyed summaries.

    The classified and the resolved key table are written; the join back
    splits hot keys, and adaptive execution broadcasts the key table when
    its measured size allows. ``JobResult.close`` removes both tables.

    Pass ``lookup`` (from ``resolve.lookup_table``, written once) to skip
    parsing the provider snapshots; otherwise the provider chain is joined.
    """
    work = scratch_path(spark, "jobs", "resolve", unique=True)
    seen = Observation("input_counts")
    (classify(ids, raw)
     .observe(seen, F.count(F.lit(1)).alias("rows_read"),
              F.count_if(F.col("v.type") != fixed.TYPE_INVALID).alias("rows_valid"))
     .write.parquet(f"{work}/classified"))
    read = dict(seen.get)
    if require_input and not read["rows_read"]:
        raise ValueError(fixed.MSG_NO_INPUT)
    if require_input and not read["rows_valid"]:
        raise ValueError(fixed.MSG_NO_VALID)
    classified = read_numbered(spark, f"{work}/classified")
    valid = valid_ids(classified)
    counts = key_counts(valid)
    keys = resolve_keys_with_lookup(counts, lookup) if lookup is not None else resolve_keys_in_turn(counts, providers)
    most = Observation("most_rows")
    keys.observe(most, F.max("n").alias("n")).write.parquet(f"{work}/keys")
    keys = spark.read.parquet(f"{work}/keys")
    results = attach(valid, keys, rows_per_split, total=read["rows_valid"], most=most.get["n"] or 0)
    return JobResult(results, rejected_ids(classified).drop(ROW), summary_rows(keys), summary_distinct(keys), work, read,
                     valid.drop(ROW), keys)


def write_report(job: JobResult, out: str, fmt: str = "csv") -> None:
    """C1 sinks: text report, JSON Lines + summary, or CSV, in input order."""
    if fmt == "text":
        P.write_text(P.text_blocks(job.results), f"{out}/report")
    elif fmt == "json":
        P.write_json(P.json_entries(job.results), f"{out}/results")
        P.write_summary(job.summary, f"{out}/summary")
    elif fmt == "csv":
        P.write_csv(P.csv_rows(job.results), f"{out}/results")
    else:
        raise ValueError(fixed.MSG_FORMAT % (fmt, ", ".join(FORMATS)))
    job.rejected.write.mode("overwrite").parquet(f"{out}/rejected")


def write_sheet(job: JobResult, target: str, mode: str = "overwrite", fmt: str = "parquet",
                as_table: bool = False, dry_run: bool = False, job_name: str | None = None) -> list[str] | None:
    """C2 sink: grid rows to a path or table; a dry run only previews.

    With ``job_name``, appending the same job again replaces its rows.
    """
    if dry_run:
        rows = G.preview_rows(job.valid, job.keys)
        return G.preview_report(rows, spreadsheet_id=target, data_rows=job.input_counts["rows_valid"])
    G.write_grid(G.sheet_rows(job.results), target, mode=mode, fmt=fmt, as_table=as_table, job=job_name)
    return None
