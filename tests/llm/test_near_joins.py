"""The joins of near-duplicate search: none passes a table through the driver."""

import pytest
from pyspark.sql import functions as F

from skein.llm import common, resemblance, simhash
from skein.sources import staging

TEXTS = [" ".join(f"w{(i // 3 * 7 + k) % 997}" for k in range(60)) + (" again" if i % 3 == 1 else "") for i in range(60)]


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that is staged."""
    seen, staged = [], staging.staged

    def spy(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(staging, "staged", spy)
    monkeypatch.setattr(common, "staged", spy)
    return seen


@pytest.mark.parametrize("search", [simhash.near_dedup, resemblance.near_roots, simhash.deduplicated])
def test_no_table_is_broadcast(spark, plans, search):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    out = search(docs)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("Join" in p for p in plans) and not [p for p in plans if "Broadcast" in p]


def test_near_stage_goes_through_the_golay_keys(spark, monkeypatch):
    """Without bands, near copies within three bits are still found; texts within three bits that aren't alike by their words stay apart."""
    prints = resemblance.prints
    monkeypatch.setattr(resemblance, "prints", lambda docs: prints(docs).withColumn("bands", F.array("fp")))
    rows, near = [], 0
    for i in range(40):
        text = " ".join(f"t{i}x{k}" for k in range(400))
        other = text + " end"
        if (simhash.fingerprint(text.encode()) ^ simhash.fingerprint(other.encode())).bit_count() <= simhash.DISTANCE:
            rows += [(3 * i, text), (3 * i + 1, other)]
            near += 1
    assert near > 10
    cycle = "one two three " * 500
    apart = [(1000 + i, cycle + " ".join(f"u{i}x{k}" for k in range(20))) for i in range(3)]
    assert all((simhash.fingerprint(a.encode()) ^ simhash.fingerprint(apart[0][1].encode())).bit_count() <= simhash.DISTANCE for _, a in apart)
    kept = simhash.deduplicated(spark.createDataFrame(rows + apart, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in kept} == {i for i, _ in rows if i % 3 == 0} | {1000, 1001, 1002}
