import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import store as ST
from ledgerlens.operators import versions as VS
from ledgerlens.plans import reports as R
from ledgerlens.plans import views as VW

SCHEMA = "source string, txn_date timestamp_ntz, amount decimal(12,2), merchant string, category string"


def _rows(spark, n, seed, start=0):
    r = random.Random(seed)
    merchants, categories = ["Shop", "the", "swiggy@ybl", None, "", "Cafe One"], ["Food", None, "", "Other", "Rent"]
    made = [(f"s{start + i}", f"202{r.randrange(3)}-{r.randrange(1, 13):02d}-07 10:00:00" if r.random() < 0.95 else None,
             Decimal(r.randrange(1, 10**7)) / 100 if r.random() < 0.9 else None, r.choice(merchants), r.choice(categories)) for i in range(n)]
    return spark.createDataFrame(made, SCHEMA.replace("timestamp_ntz", "string")).withColumn("txn_date", F.col("txn_date").cast("timestamp_ntz"))


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _same_as_recomputed(spark, expenses, credits, as_of=(None, None)):
    names = VW.publish(spark, expenses, credits, as_of)
    e, c = VS.read_version(spark, expenses, as_of[0]), VS.read_version(spark, credits, as_of[1])
    for name, want in zip(names, (R.monthly_spend(e), R.category_spend(e), R.top_merchants(e), R.income_vs_expense(e, c))):
        assert _sorted(spark.table(name)) == _sorted(want), name
        assert spark.table(name).columns == want.columns


def _with_sums(spark, path):
    return {r.file for r in VS.read_version(spark, f"{path}/partials").select("file").distinct().collect()}


def test_views_equal_recomputation_after_every_change(spark, tmp_path):
    expenses, credits = str(tmp_path / "e"), str(tmp_path / "c")
    VS.save_version(_rows(spark, 300, 1).repartition(4), expenses)
    VS.save_version(_rows(spark, 80, 2).repartition(2), credits)
    _same_as_recomputed(spark, expenses, credits)
    first = _with_sums(spark, expenses)
    assert VS.append_rows(spark, expenses, _rows(spark, 50, 3, 300).coalesce(1)).rewritten == 0
    # only the new file is aggregated, the others' sums stay where they are
    opened = VS.table_with_files(spark, expenses, without=VS.read_version(spark, f"{expenses}/partials").select("file").distinct())
    assert opened.count() == 50
    done = VW.refresh(spark, expenses)
    assert done.rewritten == 0 and len(_with_sums(spark, expenses) - first) == 1
    assert VW.refresh(spark, expenses).version == done.version  # nothing left to do
    _same_as_recomputed(spark, expenses, credits)
    ST.delete_bad_from_table(spark, expenses)
    _same_as_recomputed(spark, expenses, credits)
    ST.reclean_table(spark, expenses)
    _same_as_recomputed(spark, expenses, credits)
    _same_as_recomputed(spark, expenses, credits, (1, 1))  # an earlier version from the sums that are kept
    VW.drop_stale(spark, expenses)
    assert _with_sums(spark, expenses) == {r.file for r in VS.version_files(spark, expenses).collect()}
    _same_as_recomputed(spark, expenses, credits)
    with pytest.raises(VW.StaleViews):
        VW.publish(spark, expenses, credits, (1, None))


def test_two_refreshes_count_a_file_once(spark, tmp_path, monkeypatch):
    """A second refresh commits while the first one works: the first finds nothing left."""
    path, other = str(tmp_path / "e"), str(tmp_path / "c")
    VS.save_version(_rows(spark, 60, 4).repartition(3), path)
    VS.save_version(_rows(spark, 5, 5), other)
    real, runs = VW.partial_sums, []

    def meanwhile(rows):
        runs.append(1)
        if len(runs) == 2:  # the first call is for the schema
            monkeypatch.setattr(VW, "partial_sums", real)
            VW.refresh(spark, path)
        return real(rows)

    monkeypatch.setattr(VW, "partial_sums", meanwhile)
    VW.refresh(spark, path)
    assert len(runs) == 2
    _same_as_recomputed(spark, path, other)


def test_views_of_empty_tables_and_clashing_names(spark, tmp_path):
    expenses, credits = str(tmp_path / "e"), str(tmp_path / "c")
    clashing = _rows(spark, 40, 6).select("*", *[F.lit(7).alias(n) for n in ("file", "kind", "month", "total", "n", "gid", "n_amounts")])
    VS.save_version(clashing, expenses)
    VS.save_version(_rows(spark, 3, 7).limit(0), credits)
    _same_as_recomputed(spark, expenses, credits)
    VS.change_files(spark, expenses, lambda t: t, lambda r, _: r.limit(0))
    names = VW.publish(spark, expenses, credits)
    assert [spark.table(n).count() for n in names] == [0, 0, 0, 0]
