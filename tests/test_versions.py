"""A stream of versions against the batch operator."""

import random

from conftest import rows
from pyspark.sql import functions as F

from docgrid.sources import catalog
from docgrid.streaming import versions

C = F.col
SCHEMA = "doc string, version string, at timestamp"


def test_versions_with_letters(spark):
    some = ["v1.0", "1.0b", "1.0.0", "v2_1", "2.10", "rev", "", "1.0a", "999999999999999999999.1", None]
    df = spark.createDataFrame([("d", v) for v in some], "doc string, version string")
    order = [r.version for r in df.orderBy(catalog.version_key(C("version")).asc_nulls_first(), "version").collect()]
    assert order == [None, "", "rev", "v1.0", "1.0.0", "1.0a", "1.0b", "v2_1", "2.10", "999999999999999999999.1"]
    assert catalog.latest(df.where("version < '9' or version is null"), "doc", "version").first().version == "2.10"
    assert catalog.latest(df.where("version is null"), "doc", "version").first().version is None


def run(spark, base, batch, number, **more):
    """One more file arrives, and the stream is started again from its checkpoint."""
    spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
    versions.start(versions.changes(stream, "doc", C("version"), **more), f"{base}/changes", f"{base}/state").awaitTermination()
    return spark.read.schema(f"{versions.CHANGES}, batch bigint").parquet(f"{base}/changes")


def test_out_of_order_batches_and_restarts(spark, tmp_path):
    rng, base, every = random.Random(3), str(tmp_path / "a"), []
    for number in range(3):
        batch = [(rng.choice(["DS1", "DS2", "RM9", None]), rng.choice(["v", ""]) + f"{rng.randint(1, 4)}.{rng.randint(0, 12)}" + rng.choice(["", "", "b"]), None) for _ in range(12)] + [("one", f"{3 - number}", None), ("two", f"{number + 1}", None), ("none", None, None)]
        every += batch
        table = run(spark, base, batch, number)
        wanted = catalog.latest(spark.createDataFrame(every, SCHEMA).where("version is not null"), "doc", "version")
        assert rows(versions.current(table)) == rows(wanted.select("doc", "version"))
    told = rows(table.where("doc = 'one'").select("batch", "version", "change", "n"))
    assert [x[1:] for x in told] == [("3", "latest", 0), ("2", "dropped", 1), ("1", "dropped", 2)]
    taken = {(r.doc, r.version) for r in table.where("change = 'taken back'").collect()}
    assert {("two", "1"), ("two", "2")} <= taken <= {(r.doc, r.version) for r in table.where("change = 'latest'").collect()}


def test_documents_are_forgotten(spark, tmp_path):
    from datetime import datetime, timedelta

    base, day = str(tmp_path / "b"), datetime(2024, 1, 1)
    more = {"at": "at", "late": "1 hour", "keep_ms": 3 * 24 * 3600 * 1000}
    run(spark, base, [("old", "2.0", day), ("new", "1.0", day)], 0, **more)
    run(spark, base, [("new", "1.1", day + timedelta(days=2))], 1, **more)
    # Past the fourth day "old" is forgotten and "new" is not.
    table = run(spark, base, [("other", "1", day + timedelta(days=4, hours=2))], 2, **more)
    assert rows(table.where("change = 'forgotten'").select("doc", "version")) == [("old", "2.0")]
    table = run(spark, base, [("old", "1.0", day + timedelta(days=4, hours=3))], 3, **more)
    assert rows(table.where("doc = 'old'").select("version", "change")) == sorted([("2.0", "latest"), ("2.0", "forgotten"), ("1.0", "latest")], key=repr)


def test_two_calls_to_the_state_a_document_and_batch():
    calls, held = [], {}

    class Value:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            def done(*value):
                calls.append(call)
                found = held.get(self.name)
                if call == "update":
                    held[self.name] = value[0]
                return found is not None if call == "exists" else found

            return done

    handle = type("Handle", (), {"getValueState": lambda self, name, schema: Value(name)})()
    processor = versions.LatestVersions(None)
    processor.init(handle)
    came = lambda *numbers: [tuple(r) for r in processor.handleInputRows(("d",), iter([{"version": str(n), "numbers": [n], "rests": [""], "at_ms": 0} for n in numbers]), None)]
    assert came(2, 1) == [("d", "1", "dropped", 1), ("d", "2", "latest", 1)] and calls == ["get", "update"]
    assert came(2) == [] and calls == ["get", "update", "get"]
    assert came(1, 3) == [("d", "1", "dropped", 2), ("d", "2", "taken back", 2), ("d", "3", "latest", 2)] and len(calls) == 5
