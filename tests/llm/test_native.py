"""URL filters, sharding and mixing, also against their SQL."""

import oracle
import pytest
from pyspark.sql import functions as F

from evidora.llm import mixing, sharding, url_filters
from evidora.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(spark, name, sf):
    oracle.same(QUERIES[name](spark, sf).toPandas(), oracle.connect(sf).execute(ORACLE_SQL[name]).fetch_df())


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q#f", "http://x.com/en/1", "http://example.com?q", "https://n.net/de/", "https://a.example.net/de/8", "ftp://o.org/es/é#x", "http://example.org/a b", "x://://y", "http://notcom/en/", "http://x.com/en/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    out = {r["page_id"]: r for r in url_filters.url_filter(pages, F.lit(None)).collect()}
    assert len(out) == len(urls)
    got = {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in out.items()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[4] == got[12] == ("x.com", "/en/1", "com/en/", "block")
    assert got[5] == ("example.com", "", None, "allow")
    assert got[6] == ("n.net", "/de/", "net/de/", "allow") and got[7][2:] == ("example.net/de/8", "block")
    assert got[8] == ("o.org", "/es/é", "org/es/", "block") and got[10][:2] == (":", "//y"[:0] + "//y") and got[11][2] is None


def test_reputation_blocks_bad_hosts_and_spares_small_ones(spark):
    rows = [("http://bad.test/a", 1)] * 60 + [("http://good.test/a", 0)] * 200 + [("http://new.test/a", 1)] + [("http://other.example/a", 0)] * 300
    pages = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, b int")
    out = url_filters.url_filter(pages, F.col("b"), rules=()).groupBy("host").agg(F.first("verdict"), F.count("*")).collect()
    assert {r[0]: r[1] for r in out} == {"bad.test": "block", "good.test": "allow", "new.test": "allow", "other.example": "allow"}


def test_url_filter_of_nothing(spark):
    assert url_filters.url_filter(spark.createDataFrame([], "page_id long, url string"), F.lit(1)).count() == 0


def test_shards_fit_and_only_large_buckets_split(docs_frame, prose):
    texts = [prose(50 + i % 40, i) for i in range(300)] + [None, "", "x" * 9000] + ["same"] * 3
    ids = list(range(303)) + [900] * 3
    out = sharding.shard_documents(docs_frame(texts, ids=ids), limit=4000).toPandas()
    assert sorted(out.doc_id) == sorted(ids)
    sums = out.groupby(["shard", "part"]).n_bytes.sum()
    alone = out[out.n_bytes > 4000].set_index(["shard", "part"]).index
    assert (sums[~sums.index.isin(alone)] <= 4000).all() and (sums[sums.index.isin(alone)] == 9000).all()
    shards = {s for s in out.shard if len(s) < sharding.BITS}
    for s in shards:  # the parent of each shard was too large
        parent = out[[x.startswith(s[:-1]) for x in out.shard]]
        assert not s or parent.n_bytes.sum() > 4000


def test_copies_beyond_the_limit_are_cut_into_parts(docs_frame):
    out = sharding.shard_documents(docs_frame(["y" * 100] * 50, ids=[None] * 50), limit=1000).toPandas()
    assert len(out) == 50 and (out.groupby(["shard", "part"]).n_bytes.sum() <= 1000).all()
    assert sharding.shard_documents(docs_frame([])).count() == 0


def test_shards_written(spark, docs_frame, prose, tmp_path):
    docs = docs_frame([prose(60, i) for i in range(40)])
    sharding.write_shards(docs, f"{tmp_path}/out", 4000)
    assert spark.read.parquet(f"{tmp_path}/out").select("doc_id").distinct().count() == 40


def waterfill(sizes, weights, most=3):
    target, open_ = {}, dict(weights)
    left = sum(sizes.values())
    while open_:
        share = left / sum(open_.values())
        full = [s for s in open_ if most * sizes[s] < share * open_[s]]
        if not full:
            return target | {s: share * w for s, w in open_.items()}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mix_meets_targets(docs_frame, prose):
    import random

    rng = random.Random(3)
    names = ["b", "a", None, "c", "é"]
    sources = [rng.choice(names) for _ in range(400)]
    texts = [prose(rng.randint(1, 60), i) for i in range(400)]
    texts[0], texts[1] = None, " \t\n"
    out = mixing.sample_plan(docs_frame(texts, sources)).toPandas()
    again = mixing.sample_plan(docs_frame(texts, sources)).toPandas()
    assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.size_ for r in out.rename(columns={"size": "size_"}).itertuples()} == size
    order = ["a", "b", "c", "é", None]
    sizes = {s: sum(size[i] for i in range(400) if sources[i] == s) for s in order}
    expected = waterfill(sizes, {s: [1, 2, 3][k % 3] for k, s in enumerate(order)})
    for s in order:
        own = out[[sources[i] == s for i in out.doc_id]]
        assert own.target.iloc[0] == pytest.approx(expected[s]) and abs(own.taken.sum() - expected[s]) <= 1
    assert (out.taken <= 3 * out["size"]).all()


def test_small_sources_stop_at_three_times(docs_frame):
    docs = docs_frame(["w " * 100] * 9 + ["w w"] * 2, ["a"] * 9 + ["b"] * 2)
    out = mixing.sample_plan(docs).toPandas()
    small = out[out["size"] == 2]
    assert (small.target == 12).all() and (small.taken == 6).all()
    mixed = mixing.mixed_documents(docs).toPandas()
    assert (mixed.source == "b").sum() == 6 and list(mixed.columns) == docs.columns
    assert mixed.text.str.split().str.len().sum() == out.taken.sum()
    assert mixing.sample_plan(docs_frame([])).count() == 0 and mixing.sample_plan(docs_frame([None, ""])).toPandas().taken.sum() == 0


def test_equal_rows_of_a_budget(docs_frame):
    """Copies of one row share what the budget leaves: some whole, one in part, and reruns and texts agree."""
    docs = docs_frame(["w w w w"] * 40 + ["v"] * 200, ["a"] * 40 + ["b"] * 200, ids=[None] * 40 + list(range(200)))
    docs = docs.selectExpr("*", "1 as h", "2 as taken", "3 as _size", "4 as row", "5 as many")
    plan = mixing.sample_plan(docs).toPandas()
    own = plan[plan.doc_id.isna()]
    assert own.many.sum() == 40 and abs((own.taken * own.many).sum() - own.target.iloc[0]) <= 1 and len(own) <= 3
    mixed = mixing.mixed_documents(docs).toPandas()
    assert mixed[mixed.source == "a"].text.str.split().str.len().sum() == (own.taken * own.many).sum()
    assert mixed.columns.tolist() == docs.columns and (mixed.h == 1).all() and (mixed.many == 5).all()
    assert mixing.mixed_documents(docs_frame([])).count() == 0


def test_many_copies_of_a_row(spark, monkeypatch):
    from evidora.llm import common

    monkeypatch.setattr(common, "ROWS_PER_BUCKET", 16)
    rows = spark.createDataFrame([("a", 1), ("b", 16), ("c", 100)], "k string, n long")
    assert dict(common.copied(rows, "n").groupBy("k").count().collect()) == {"a": 1, "b": 16, "c": 100}
    n = common.numbered(common.copied(rows, "n"), "k", "place").groupBy("k").agg(F.countDistinct("place").alias("d"), F.max("place").alias("m")).collect()
    assert {r["k"]: (r["d"], r["m"]) for r in n} == {"a": (1, 0), "b": (16, 15), "c": (100, 99)}


def test_parts_written_hold_every_copy_once(spark, docs_frame, tmp_path):
    docs = docs_frame(["y" * 100] * 50 + ["z" * 100_000], ids=[None] * 50 + [1]).selectExpr("*", "1 as h", "2 as part", "3 as last")
    sharding.write_shards(docs, f"{tmp_path}/out", 1000)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 51 and out.filter("doc_id is null").groupBy("shard", "part").count().agg(F.max("count")).first()[0] <= 10
    assert out.select("h", "last").distinct().collect() == [(1, 3)]


def test_no_shared_folder_is_an_error_on_a_cluster():
    from evidora.llm import common

    class Session:
        class conf:
            get = staticmethod(lambda key, other: other)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_folder(Session)


def test_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 50_000 + "com/en/x"), (2, "http://h.test/" + "p" * 200_000)], "page_id long, url string")
    out = {r["page_id"]: r for r in url_filters.url_filter(pages, F.lit(0)).collect()}
    assert out[1]["rule"] == "com/en/" and len(out[2]["path"]) == 200_001
