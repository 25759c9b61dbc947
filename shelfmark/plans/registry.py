"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator, each over whole derived tables (see ``derive/inputs.py``).

Array members are returned as JSON text (``to_json``) so a NULL list, an
empty list and a list of values stay distinguishable in comparisons.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..derive import inputs as D
from ..functions.fields import extract_sheet_id, range_error
from ..functions.isbn import isbn10_to_13, is_isbn10, is_isbn13, normalize_id
from ..operators import resolve as R
from ..operators.providers import default_providers
from ..operators.summary import summary_distinct, summary_rows
from ..operators.upkeep import lookup_from_responses, merge_responses, save_responses
from ..operators.validate import classify, input_counts, rejected_ids, valid_ids
from ..session import configure, parallelism, scratch_path
from ..sources.lines import ids_from_column, read_id_lines
from ..sources.sheets import read_grid_export, read_grid_manifest, sheet_column_ids, sheet_row_count
from ..streaming.ids import clean_ids_to, hot_keys, resolve_stream, resolved_stream, stream_summary
from . import grid as G
from . import report as P

Query = Callable[[SparkSession, str], DataFrame]


def _raw(spark, sf):
    configure(spark)
    return D.load(spark, sf, "raw_ids")


def _classified(spark, sf):
    return classify(_raw(spark, sf))


def _valid(spark, sf):
    return valid_ids(_raw(spark, sf))


def _providers(spark, sf):
    configure(spark)
    return default_providers(D.load(spark, sf, "snapshot_a"), D.load(spark, sf, "snapshot_b"))


# The provider snapshots parsed once into a per-key lookup table (written
# into the shared folder); every result-producing query joins against it.
D.register("lookup", lambda spark, sf: R.lookup_table(_providers(spark, sf)), "parquet", "isbn")


def _lookup(spark, sf):
    configure(spark)
    return D.load(spark, sf, "lookup")


def _results(spark, sf):
    return R.resolve_with_lookup(_valid(spark, sf), _lookup(spark, sf))


def _keys(spark, sf):
    return R.resolve_keys_with_lookup(R.key_counts(_valid(spark, sf)), _lookup(spark, sf))


def _flat_meta() -> list:
    return [
        F.col("meta.isbn_10").alias("isbn_10"), F.col("meta.isbn_13").alias("isbn_13"),
        F.col("meta.title").alias("title"), F.to_json(F.col("meta.authors")).alias("authors"),
        F.col("meta.publisher").alias("publisher"), F.col("meta.publication_date").alias("publication_date"),
        F.col("meta.pages").alias("pages"), F.to_json(F.col("meta.categories")).alias("categories"),
    ]


# --- identifiers -------------------------------------------------------------

def q_normalize_ids(spark, sf):
    r = _raw(spark, sf)
    return r.select("pos", "raw", normalize_id("raw").alias("normalized"))


def q_check_isbn10(spark, sf):
    r = _raw(spark, sf).select("pos", normalize_id("raw").alias("candidate"))
    return r.select("pos", "candidate", is_isbn10("candidate").alias("ok"))


def q_check_isbn13(spark, sf):
    r = _raw(spark, sf).select("pos", normalize_id("raw").alias("candidate"))
    return r.select("pos", "candidate", is_isbn13("candidate").alias("ok"))


def q_classify_ids(spark, sf):
    return _classified(spark, sf).select("pos", "raw", "v.type", "v.normalized", "v.error")


def q_valid_ids(spark, sf):
    return _valid(spark, sf).select("pos", "raw", "id_type", "isbn")


def q_rejected_ids(spark, sf):
    return rejected_ids(_raw(spark, sf)).select("pos", "raw", "reason")


def q_isbn10_to_13(spark, sf):
    r = _raw(spark, sf).select("pos", normalize_id("raw").alias("isbn"))
    return r.select("pos", "isbn", isbn10_to_13("isbn").alias("isbn13"))


def q_input_counts(spark, sf):
    return input_counts(_raw(spark, sf))


# --- sources -----------------------------------------------------------------

def q_scan_id_lines(spark, sf):
    configure(spark)
    return read_id_lines(spark, D.materialize(spark, sf, "id_lines"), in_order=False).select("raw")


def q_id_lines_in_order(spark, sf):
    """The cleaned lines with their numbers over all files."""
    configure(spark)
    return read_id_lines(spark, D.materialize(spark, sf, "id_lines")).select("pos", "raw")


def q_scan_id_literals(spark, sf):
    configure(spark)
    lit = ids_from_column(D.load(spark, sf, "decorated_ids"), "raw", pos="pos")
    return classify(lit).select("pos", "raw", "v.type", "v.error")


# The derived export holds its ids in the third column.
SHEET_RANGE = "Sheet1!C1:C"


def q_scan_sheet_column(spark, sf):
    configure(spark)
    grid = read_grid_export(spark, D.materialize(spark, sf, "sheet_grid"), SHEET_RANGE)
    return sheet_column_ids(grid).select("raw")


def q_sheet_row_count(spark, sf):
    configure(spark)
    return sheet_row_count(read_grid_export(spark, D.materialize(spark, sf, "sheet_grid"), SHEET_RANGE))


def q_scan_sheet_manifest(spark, sf):
    """S4/P10 over many exports: each is scanned by the range that the manifest gives for it."""
    configure(spark)
    manifest = D.load(spark, sf, "job_manifest").select(F.concat(F.lit("export="), F.col("job_id")).alias("export"), "range")
    folder = F.element_at(F.split("file", "/"), -2)
    return read_grid_manifest(spark, D.materialize(spark, sf, "sheet_exports"), manifest, folder)


def _hits(provider_index: int):
    def q(spark, sf):
        p = _providers(spark, sf)[provider_index]
        return p.hits().select("isbn", F.lit(p.name).alias("provider"), *_flat_meta())
    return q


def q_extract_sheet_ids(spark, sf):
    configure(spark)
    m = D.load(spark, sf, "job_manifest")
    return m.select("job_id", "sheet_ref", extract_sheet_id("sheet_ref").alias("sheet_id"))


def q_check_ranges(spark, sf):
    configure(spark)
    m = D.load(spark, sf, "job_manifest")
    return m.select("job_id", "range", range_error("range").alias("range_error"))


# --- resolution --------------------------------------------------------------

def q_resolve(spark, sf):
    res = _results(spark, sf)
    return res.select("pos", "isbn", "provider", *_flat_meta(), "error")


def q_resolve_chain(spark, sf):
    """The same result through the provider join chain (no lookup table)."""
    res = R.resolve(_valid(spark, sf), _providers(spark, sf))
    return res.select("pos", "isbn", "provider", *_flat_meta(), "error")


def q_fallback_keys(spark, sf):
    return R.fallback_keys(R.key_counts(_valid(spark, sf)), _providers(spark, sf)).select("isbn")


# Folders of the response store that the registered merge works on.
STORE_BUCKETS = 16


def q_lookup_upkeep(spark, sf):
    """A store made from three quarters of the responses; then others, some of them the same ones, are merged."""
    configure(spark)
    snapshots = D.load(spark, sf, "snapshot_a"), D.load(spark, sf, "snapshot_b")
    part = F.crc32("isbn") % 4
    path = scratch_path(spark, "responses", "store", unique=True)
    save_responses(default_providers(*[s.where(part != 1) for s in snapshots]), path, STORE_BUCKETS)
    merge_responses(spark, default_providers(*[s.where(part.isin(1, 2)) for s in snapshots]), path, STORE_BUCKETS)
    return lookup_from_responses(spark, path).select("isbn", "provider", *_flat_meta())


def q_unresolved_ids(spark, sf):
    return R.unresolved_ids(R.key_counts(_valid(spark, sf)), _providers(spark, sf))


def q_resolved_ids(spark, sf):
    return R.resolved_ids(R.key_counts(_valid(spark, sf)), _providers(spark, sf))


def q_summary_rows(spark, sf):
    return summary_rows(_keys(spark, sf))


def q_summary_distinct(spark, sf):
    return summary_distinct(_keys(spark, sf))


# --- sinks -------------------------------------------------------------------

def q_csv_rows(spark, sf):
    return P.csv_rows(_results(spark, sf))


def q_sheet_rows(spark, sf):
    return G.sheet_rows(_results(spark, sf), keep=())


def q_render_text(spark, sf):
    return P.text_blocks(_results(spark, sf))


def q_json_entries(spark, sf):
    return P.json_lines(P.json_entries(_results(spark, sf)))


def q_preview_rows(spark, sf):
    return G.preview_rows(_valid(spark, sf), _lookup(spark, sf))


def q_sheet_append(spark, sf):
    rows = G.sheet_rows(_results(spark, sf))
    target = scratch_path(spark, "grid", "append", unique=True)
    G.write_grid(rows, target, mode="overwrite")
    G.write_grid(rows, target, mode="append")
    return G.read_grid(spark, target)


def q_sheet_append_jobs(spark, sf):
    """K5 with job names: one job appends twice, as after a failure, and another once."""
    rows = G.sheet_rows(_results(spark, sf))
    target = scratch_path(spark, "grid", "append-jobs", unique=True)
    for job in ("monday", "monday", "tuesday"):
        G.write_grid(rows, target, mode="append", job=job)
    return G.read_grid(spark, target)


def q_sheet_round_trip(spark, sf):
    """Grid export -> cell cleaning -> classify -> resolve -> grid write."""
    configure(spark)
    ids = sheet_column_ids(read_grid_export(spark, D.materialize(spark, sf, "sheet_grid"), SHEET_RANGE))
    res = R.resolve_with_lookup(valid_ids(ids), _lookup(spark, sf))
    target = scratch_path(spark, "grid", "round-trip", unique=True)
    G.write_grid(G.sheet_rows(res), target, mode="overwrite", fmt="csv")
    return G.read_grid(spark, target, fmt="csv")


# --- streaming ---------------------------------------------------------------

def q_stream_clean_ids(spark, sf):
    configure(spark)
    folder = D.materialize(spark, sf, "id_lines")
    out = scratch_path(spark, "stream", "clean", unique=True)
    q = clean_ids_to(spark, folder, out + "/data", out + "/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(out + "/data").select("raw")


# The registered stream reads its files in so many micro-batches (given as many files).
STREAM_BATCHES = 3


def _bucketed_lookup(spark, sf):
    """The lookup as a table bucketed by key, written once for each copy of the inputs."""
    path = D.derived_path(spark, sf, "lookup_bucketed")
    name = "shelfmark_lookup_" + "".join(c if c.isalnum() else "_" for c in path[-60:]).lower()
    if not spark.catalog.tableExists(name):
        R.save_lookup(_lookup(spark, sf), name, buckets=max(8, parallelism(spark)), path=path)
    return name


def _streamed(spark, sf, summary=None):
    """All id lines streamed in STREAM_BATCHES micro-batches; the folder of the result rows."""
    configure(spark)
    folder = D.materialize(spark, sf, "id_lines")
    out = scratch_path(spark, "stream", "resolve", unique=True)
    files = len(spark.read.text(folder).inputFiles())
    q = resolve_stream(spark, folder, _bucketed_lookup(spark, sf), out + "/data", out + "/rejects", out + "/checkpoint",
                       project=lambda r: P.csv_rows(r, keep=()), max_files_per_trigger=max(1, -(-files // STREAM_BATCHES)),
                       summary=summary)
    q.awaitTermination()
    return out + "/data"


def q_stream_resolve(spark, sf):
    return spark.read.parquet(_streamed(spark, sf)).drop("epoch")


def q_stream_summary(spark, sf):
    """A1-A4 of the streamed run, merged from its epochs."""
    summary = scratch_path(spark, "stream", "summary", unique=True)
    _streamed(spark, sf, summary)
    return stream_summary(spark, summary)


def q_stream_join_hot(spark, sf):
    """C3 as one streaming plan over the skewed ids: a hot key's rows are dealt to several salts."""
    configure(spark)
    folder = D.materialize(spark, sf, "id_lines_skewed")
    hot = hot_keys(R.key_counts(valid_ids(D.load(spark, sf, "raw_ids_skewed"))), SKEWED_ROWS_PER_SPLIT)
    out = scratch_path(spark, "stream", "join", unique=True)
    rows = resolved_stream(spark, folder, _lookup(spark, sf), hot)
    rows = rows.select("isbn", "provider", F.col("meta.title").alias("title"), "error")
    q = (rows.writeStream.format("parquet").option("path", out + "/data").option("checkpointLocation", out + "/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out + "/data")


# --- volume ------------------------------------------------------------------

# Split threshold for the skewed fixture: small enough that its hot keys
# (a third of all rows at any scale factor) take the salted path.
SKEWED_ROWS_PER_SPLIT = 1_000


def q_resolve_skewed(spark, sf):
    """J6 with hot keys: one book holds a third of the rows (salted join back)."""
    configure(spark)
    valid = valid_ids(D.load(spark, sf, "raw_ids_skewed"))
    res = R.resolve_with_lookup(valid, _lookup(spark, sf), rows_per_split=SKEWED_ROWS_PER_SPLIT)
    return res.select("pos", "isbn", "provider", F.col("meta.title").alias("title"), "error")


def q_resolve_identical_rows(spark, sf):
    """J6 at its hardest: all rows are equal (one key, no position), so only their places tell them apart."""
    configure(spark)
    valid = valid_ids(D.load(spark, sf, "raw_ids_identical"))
    res = R.resolve_with_lookup(valid, _lookup(spark, sf), rows_per_split=SKEWED_ROWS_PER_SPLIT)
    return res.select("raw", "isbn", "provider", F.col("meta.title").alias("title"), "error")


def q_bench_classify_large(spark, sf):
    configure(spark)
    c = classify(D.load(spark, sf, "raw_ids_large"))
    return c.groupBy(F.col("v.type").alias("type"), F.col("v.error").alias("error")).agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Query] = {
    "normalize_ids": q_normalize_ids,
    "check_isbn10": q_check_isbn10,
    "check_isbn13": q_check_isbn13,
    "classify_ids": q_classify_ids,
    "valid_ids": q_valid_ids,
    "rejected_ids": q_rejected_ids,
    "isbn10_to_13": q_isbn10_to_13,
    "input_counts": q_input_counts,
    "scan_id_lines": q_scan_id_lines,
    "id_lines_in_order": q_id_lines_in_order,
    "scan_id_literals": q_scan_id_literals,
    "scan_sheet_column": q_scan_sheet_column,
    "sheet_row_count": q_sheet_row_count,
    "scan_sheet_manifest": q_scan_sheet_manifest,
    "provider_a_hits": _hits(0),
    "provider_b_hits": _hits(1),
    "extract_sheet_ids": q_extract_sheet_ids,
    "check_ranges": q_check_ranges,
    "resolve": q_resolve,
    "resolve_chain": q_resolve_chain,
    "fallback_keys": q_fallback_keys,
    "lookup_upkeep": q_lookup_upkeep,
    "unresolved_ids": q_unresolved_ids,
    "resolved_ids": q_resolved_ids,
    "summary_rows": q_summary_rows,
    "summary_distinct": q_summary_distinct,
    "csv_rows": q_csv_rows,
    "sheet_rows": q_sheet_rows,
    "render_text": q_render_text,
    "json_entries": q_json_entries,
    "preview_rows": q_preview_rows,
    "sheet_append": q_sheet_append,
    "sheet_append_jobs": q_sheet_append_jobs,
    "sheet_round_trip": q_sheet_round_trip,
    "stream_clean_ids": q_stream_clean_ids,
    "stream_resolve": q_stream_resolve,
    "stream_summary": q_stream_summary,
    "stream_join_hot": q_stream_join_hot,
    "resolve_skewed": q_resolve_skewed,
    "resolve_identical_rows": q_resolve_identical_rows,
    "bench_classify_large": q_bench_classify_large,
}
