"""Streaming: restart from the checkpoint adds nothing; new files are picked up."""

import os

from shelfmark.operators.resolve import lookup_table, save_lookup
from shelfmark.streaming.ids import resolve_stream
from test_resolve import _providers


def _write(folder, name, lines):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_restart_and_incremental(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    lookup = "stream_lookup_restart"
    save_lookup(lookup_table(_providers(spark)), lookup, 4, path=os.path.join(tmp_dir, "lookup"))
    out, rej, ck = (os.path.join(tmp_dir, d) for d in ("out", "rej", "ck"))

    def run():
        resolve_stream(spark, src, lookup, out, rej, ck).awaitTermination()
        return spark.read.parquet(out), spark.read.parquet(rej)

    _write(src, "a.txt", ["# ids", "978-0134190440", "bad", "0-596-52068-9"])
    res, bad = run()
    assert res.count() == 2 and bad.count() == 1
    res, bad = run()                                   # nothing new: no duplicates
    assert res.count() == 2 and bad.count() == 1
    _write(src, "b.txt", ["9780132350884", "9780134190440"])
    res, bad = run()
    assert res.count() == 4 and bad.count() == 1
    assert sorted(r.isbn for r in res.collect()) == ["0596520689", "9780132350884", "9780134190440",
                                                     "9780134190440"]


def test_native_stream_static_join_equals_foreach_batch(spark, tmp_dir):
    from shelfmark.streaming.ids import resolved_stream

    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    _write(src, "a.txt", ["978-0134190440", "bad", "0-596-52068-9", "9780132350884", "9780134190440"])
    lookup = save_lookup(lookup_table(_providers(spark)), "stream_lookup_native", 4, path=os.path.join(tmp_dir, "lookup"))
    native = os.path.join(tmp_dir, "native")
    (resolved_stream(spark, src, lookup).select("isbn", "provider", "error").writeStream.format("parquet")
     .option("path", native).option("checkpointLocation", native + "-ck").trigger(availableNow=True)
     .start().awaitTermination())
    out = os.path.join(tmp_dir, "fb")
    resolve_stream(spark, src, "stream_lookup_native", out, out + "-rej", out + "-ck").awaitTermination()
    cols = ["isbn", "provider", "error"]
    assert sorted(spark.read.parquet(native).select(*cols).collect()) == \
        sorted(spark.read.parquet(out).select(*cols).collect())
