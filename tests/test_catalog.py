import pytest
from pyspark.sql import functions as F

from cairn.functions.backends import StubBackend
from cairn.operators import catalog, context, filters
from cairn.operators.incremental import VersionedTarget, complete_hashes, pending, pending_documents
from cairn.plans.ranking import numbered
from cairn.plans.skew import salted_join


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_upsert_keeps_ids_and_classifies(spark, docs):
    have = docs([("n", "a.md", "A", "alpha"), ("n", "b.md", "B", "beta", False), ("n", "c.md", "C", "gamma"), ("n", "d.md", "D", "delta", None)])
    walked = catalog.with_hash(spark.createDataFrame([("n", "a.md", "A2", "alpha two"), ("n", "b.md", "B", "beta"), ("n", "c.md", "other title", "gamma"), ("n", "new.md", "N", "new"), ("n", "new.md", "N", "new")], "collection string, path string, title string, text string"))
    assert {r.path: r.outcome for r in catalog.classify(have, walked).collect()} == {"a.md": "updated", "b.md": "reactivated", "c.md": "unchanged", "new.md": "new"}
    rows = {r.path: r for r in catalog.upsert_documents(have, walked, "2026").collect()}
    assert len(rows) == 5 and rows["a.md"].doc_id == 1 and rows["a.md"].title == "A2" and rows["a.md"].created_at == "2025-01-01T00:00:00Z" and rows["a.md"].modified_at == "2026"
    assert rows["b.md"].active is True and rows["c.md"].title == "C" and rows["d.md"].active is None and rows["new.md"].doc_id == 5
    assert sorted(r.doc_id for r in catalog.upsert_documents(have.limit(0), walked, "2026").collect()) == [1, 2, 3, 4]
    gone = catalog.missing_documents(have, walked)
    assert [r.path for r in gone.collect()] == ["d.md"]
    after = catalog.deactivate(have, gone)
    assert ids(filters.active(after)) == [1, 3] and catalog.missing_documents(after, walked).count() == 0
    assert catalog.missing_documents(have, walked.limit(0)).count() == 0


def test_first_content_wins(spark):
    have = spark.createDataFrame([("h1", "stored", "1")], "hash string, doc string, created_at string")
    new = spark.createDataFrame([("h1", "other", "0"), ("h2", "late", "2"), ("h2", "early", "1"), (None, "x", "1")], have.schema)
    assert [tuple(r) for r in catalog.new_content(have, new).collect()] == [("h2", "early", "1")]


def test_purge_keeps_shared_content(spark, docs):
    d = docs([("keep", "a.md", "A", "shared", False), ("drop", "b.md", "B", "shared"), ("drop", "c.md", "C", "own")])
    content = d.select("hash", F.col("text").alias("doc"), "created_at").dropDuplicates(["hash"])
    vectors = d.select("hash", F.lit(0).cast("bigint").alias("seq"), F.col("doc_id").alias("vid")).dropDuplicates(["hash"])
    names = spark.createDataFrame([("keep",), ("drop",)], "name string")
    made = catalog.purge_collection(d, content, vectors, names, "drop")
    assert ids(made["documents"]) == [1] and [r.doc for r in made["content"].collect()] == ["shared"] and made["content_vectors"].count() == 1
    assert sorted(r.filepath for r in made["removed"].collect()) == ["drop/b.md", "drop/c.md"] and [r.name for r in made["collections"].collect()] == ["keep"]
    assert catalog.orphan_vectors(vectors, made["documents"]).count() == 2 and catalog.clear_vectors(vectors, d, "drop").count() == 0


def test_vectors_and_embedding(spark, docs):
    d = docs([("n", "a.md", "A", "alpha text"), ("n", "b.md", "B", "alpha text"), ("n", "c.md", "C", " "), ("n", "d.md", "D", None)])
    content = d.where("text is not null").select("hash", F.col("text").alias("doc"), "created_at").dropDuplicates(["hash"])
    from cairn.schemas import CONTENT_VECTORS

    none = spark.createDataFrame([], CONTENT_VECTORS)
    assert catalog.pending_hashes(d, none).count() == 1
    made = catalog.embed_pending(d, content, none, StubBackend(8), "now").collect()
    assert [(r.seq, r.vid, len(r.embedding), r.total_chunks) for r in made] == [(0, 0, 8, 1)]
    stored = spark.createDataFrame(made, CONTENT_VECTORS)
    assert catalog.pending_hashes(d, stored).count() == 0
    newer = stored.withColumn("vid", F.lit(9).cast("bigint"))
    assert [r.vid for r in catalog.upsert_vectors(stored, newer.unionByName(stored)).collect()] == [9]
    assert catalog.stale_fingerprints(stored, "zzz").count() == 1 and catalog.fingerprints(stored).first().n == 1


def test_collections_and_settings(spark, docs):
    d = docs([("old", "a.md", "A", "alpha")])
    names = spark.createDataFrame([("old", "/r", None, None, False, "sync", None)], "name string, path string, pattern string, ignore array<string>, include_by_default boolean, update_command string, allow_hidden boolean")
    config = spark.createDataFrame([("context:doc://old/x/", "c"), ("other", None)], "key string, value string")
    again = catalog.upsert_collection(names, {"name": "old", "path": "/r2"}).first()
    assert again.path == "/r2" and again.include_by_default is True and again.update_command is None and again.pattern == "**/*.md"
    made = catalog.rename_collection(d, names, config, "old", "new")
    assert made["documents"].first().collection == "new" and sorted(r.key for r in made["config"].collect()) == ["context:doc://new/x/", "other"]
    for bad in (("none", "x"), ("old", "old")):
        with pytest.raises(ValueError):
            catalog.rename_collection(d, names, config, *bad)
    assert catalog.set_field(names, "old", "include_by_default", True).first().include_by_default is True
    assert catalog.set_config(config, "other", "v").where("key = 'other'").first().value == "v" and catalog.delete_config(config, "other").count() == 1
    assert catalog.config_by_prefix(config, "context:").count() == 1


# ---------------------------------------------------------------- filters


def test_default_scope(spark, docs):
    d = docs([("visible", "a.md", "A", "x"), ("hidden", "b.md", "B", "y"), ("null", "c.md", "C", "z")])
    catalog_rows = spark.createDataFrame([("visible", True), ("hidden", False), ("null", None)], "name string, include_by_default boolean")
    assert ids(filters.default_scope(d, catalog_rows)) == [1, 3]
    assert ids(filters.default_scope(d, catalog_rows, ["hidden"])) == [2]
    assert ids(filters.default_scope(d, catalog_rows.limit(0))) == [1, 2, 3]
    assert ids(filters.default_scope(d, catalog_rows.where("name = 'hidden'"))) == []


def test_docid_is_literal_and_settled(spark):
    rows = [(1, "b", "x", "ab_cd0", True), (2, "a", "y", "abXcd0", True), (3, "a", "x", "abZZ", True), (4, "0", "0", "abZZ", False)]
    d = spark.createDataFrame(rows, "doc_id bigint, collection string, path string, hash string, active boolean")
    assert [(r.docid, r.doc_id) for r in filters.by_docid(d, ["#ab_cd", "ab", "no", "ab"]).orderBy("docid").collect()] == [("ab", 3), ("ab_cd", 1)]
    assert filters.by_docid(d, []).count() == 0


def test_needles_globs_multi_get(spark, docs):
    d = docs([("n", "SYNTAX.md", "", "1"), ("n", "OLD-SYNTAX.md", "", "2"), ("n", "guide/SYNTAX.md", "", "3"), ("n", "a_b.md", "", "4"), ("n", "axb.md", "", "5"), ("n", "gone/SYNTAX.md", "", "6", False), ("n", "a#b [c](d)&.md", "", "7")])
    assert ids(filters.by_needles(d, ["SYNTAX.md"])) == [1, 3] and ids(filters.by_needles(d, ["n/guide/SYNTAX.md", "a_b.md"])) == [3, 4]
    assert ids(filters.by_needles(d, [])) == [] and ids(filters.by_needles(d, ["a#b [c](d)&.md"])) == [7]
    assert ids(filters.by_glob(d, "n/guide/*")) == [3] and ids(filters.by_glob(d, "guide/*")) == [] and ids(filters.by_glob(d, "*")) == [1, 2, 3, 4, 5, 7]
    assert ids(filters.by_glob(d, "n/a?b.md")) == [4, 5] and ids(filters.by_glob(d, "n/a[!x]b.md")) == [4] and ids(filters.by_glob(d, "a?b.md")) == []
    with pytest.raises(ValueError):
        filters.by_glob(d, "docs/[unterminated")
    h = d.where("doc_id = 4").first().hash[:6]
    assert [r.doc_id for r in filters.multi_get(d, f"#{h}, n/guide/*, SYNTAX.md,doc://n/SYNTAX.md").collect()] == [1, 4, 3]
    assert ids(filters.list_paths(d, "n/guide")) == [3] and ids(filters.list_paths(d)) == [1, 2, 3, 4, 5, 7]
    assert ids(filters.at_filepath(d, "n", "gone/SYNTAX.md")) == [6] and ids(filters.at_ids(d, d.where("doc_id > 5"))) == [6, 7]


def test_specs_and_lines(spark):
    assert filters.parse_spec("#abc")["docid"] == "abc"
    assert filters.parse_spec("doc://c/a/b.md:10:5") == {"docid": None, "collection": "c", "path": "a/b.md", "from": 10, "count": 5}
    assert filters.parse_spec("c/a:b.md")["path"] == "a:b.md"
    with pytest.raises(ValueError):
        filters.parse_spec("nothing")
    df = spark.createDataFrame([("one\ntwo\nthree\n",), (None,), ("",)], "b string")
    assert [r[0] for r in df.select(filters.numbered_lines(F.col("b"), 2, 5)).collect()][:2] == ["   2: two\n   3: three", None]
    assert filters.capped(df.where("b is not null"), 1, ["b"]).first().total == 2


def test_context_falls_back(spark, docs):
    d = docs([("vault", "Cloud/Kube/pods.md", "", "1"), ("vault", "Cloud/x.md", "", "2"), ("vault", "y.md", "", "3"), ("other", "z/z.md", "", "4")])
    keys = [("context:doc://vault/", "root"), ("context:doc://vault/Cloud/", None), ("context:doc://vault/Cloud/Kube/", "kube"), ("context:/", "all")]
    config = spark.createDataFrame(keys, "key string, value string")
    got = lambda c, **k: {r.doc_id: r.context for r in context.with_context(d, c, ["doc_id"], **k).collect()}
    assert got(config) == got(config, most_broadcast=0) == {1: "kube", 2: "root", 3: "root", 4: "all"}
    assert got(config.limit(0)) == {1: None, 2: None, 3: None, 4: None}
    assert context.context_key("/") == "context:/" and context.context_key("vault", {"vault"}) == "context:doc://vault/"
    with pytest.raises(ValueError):
        context.context_key("nowhere", {"vault"})


# ---------------------------------------------------------------- incremental


def test_pending_documents(spark, docs):
    d = docs([("n", "a", "", "full"), ("n", "b", "", "part"), ("n", "c", "", "old"), ("n", "d", "", " \n"), ("n", "e", "", None), ("n", "f", "", "off", False), ("n", "g", "", "none", None), ("n", "h", "", "full")])
    h = {r.text: r.hash for r in d.collect()}
    v = [(h["full"], 0, "f", 2, 1), (h["full"], 1, "f", 2, 2), (h["full"], 1, "f", 2, 2), (h["part"], 1, "f", 2, 3), (h["part"], 0, "f", 2, None), (h["part"], 5, "f", 2, 8), (h["old"], 0, "g", 1, 4), (None, 0, "f", 1, 5)]
    vectors = spark.createDataFrame(v, "hash string, seq bigint, embed_fingerprint string, total_chunks bigint, vid bigint")
    assert ids(pending_documents(d, vectors, "f")) == [2, 3, 7]
    assert ids(pending_documents(d, vectors.limit(0), "f")) == [1, 2, 3, 7, 8] and ids(pending_documents(d, vectors, None)) == [1, 2, 3, 7, 8]
    assert complete_hashes(vectors, "f").count() == 1 and ids(pending_documents(d.limit(0), vectors, "f")) == []


def test_versioned_target_survives_a_failed_run(spark, tmp_path):
    target = VersionedTarget(spark, str(tmp_path / "t"))
    source = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "k bigint, v string, extra string")
    work = lambda df: df.withColumn("made", F.upper("extra"))
    assert target.current() is None and target.run(source, ["k"], "v", work) == 1
    assert target.run(source, ["k"], "v", work) is None  # a null version is known too

    def dies(df):
        raise RuntimeError("lost")

    changed = source.withColumn("v", F.when(F.col("k") == 2, "b2").otherwise(F.col("v"))).unionByName(spark.createDataFrame([(4, "d", "w")], source.schema))
    with pytest.raises(RuntimeError):
        target.run(changed, ["k"], "v", dies)
    assert target.current().count() == 3
    seen = []
    assert target.run(changed, ["k"], "v", lambda df: (seen.extend(r.k for r in df.collect()), work(df))[1]) == 2
    assert sorted(seen) == [2, 4] and {(r.k, r.v) for r in target.current().collect()} == {(1, "a"), (2, "b2"), (3, None), (4, "d")}
    source.limit(0).write.parquet(str(tmp_path / "t" / "v-9-leftover"))
    assert target.vacuum(keep=1) == [] and list(target.versions()) == [2]  # what is young may be a run's that isn't done
    assert target.vacuum(keep=1, lease=-1) == ["v-9-leftover"] and target.current().count() == 4
    assert target.compact() == 3 and target.compact() is None and target.current().count() == 4 and len(target.manifest(3)) == 1
    assert len(target.vacuum(keep=1, lease=-1)) == 3 and {(r.k, r.v) for r in target.current().collect()} == {(1, "a"), (2, "b2"), (3, None), (4, "d")}


def test_pending_with_clashing_columns(spark):
    a = spark.createDataFrame([(1, "x", "q"), (1, "x", "q"), (2, None, "r")], "k bigint, v string, _done_0 string")
    b = spark.createDataFrame([(2, None, "other")], "k bigint, v string, _other string")
    assert pending(a, b, ["k"], "v").count() == 2 and pending(a, b.limit(0), ["k"], "v").count() == 3


def test_numbered_hot_groups(spark):
    df = spark.range(2000).select((F.col("id") % 10 == 0).alias("_x"), F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.lit("b")).alias("g"), (F.col("id") * 7919 % 2003).alias("o"))
    want = {(r.g, r.o): r.n for r in numbered(df, ["g"], [F.asc("o")], "n").collect()}
    assert {(r.g, r.o): r.n for r in numbered(df, ["g"], [F.asc("o")], "n", hot_rows=100).collect()} == want and len(want) == 2000


def test_salted_join_is_a_join(spark):
    left = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("k"))
    right = left.select("k").distinct().withColumn("v", F.length("k"))
    assert sorted(r.id for r in salted_join(left, right, "k", "id").collect()) == sorted(r.id for r in left.join(right, "k").collect())


def test_a_run_may_die_anywhere(spark, tmp_path, monkeypatch):
    """A run killed before or after each of its steps, with a vacuum in between, skips nothing and repeats nothing."""
    source = spark.createDataFrame([(i, "a") for i in range(40)], "k int, v string")
    changed = source.where("k > 1").unionByName(spark.createDataFrame([(1, "b"), (0, "b"), (40, "a")], "k int, v string"))
    steps = ("_write", "_announce", "_write_gone")
    for step in steps:
        for after in (False, True):
            target = VersionedTarget(spark, str(tmp_path / f"{step}{after}"), ["k"])
            assert target.run(source, ["k"], "v", lambda d: d) == 1
            before = target.current().count()
            calls = []

            def dying(f):
                def run(*a):
                    calls.append(1)
                    mine = step != "_write_gone" or len(calls) == 2
                    if mine and not after:
                        raise OSError("killed")
                    made = f(*a)
                    if mine and step != "_announce":
                        raise OSError("killed")
                    return made

                return run

            with monkeypatch.context() as m:
                name = step.removesuffix("_gone")
                m.setattr(target, name, dying(getattr(target, name)))
                if step == "_announce" and after:
                    assert target.run(changed, ["k"], "v", lambda d: d) == 2  # published: nothing is left to do
                else:
                    with pytest.raises(OSError):
                        target.run(changed, ["k"], "v", lambda d: d)
                    assert target.current().count() == before and target.versions() == [1]
            target.vacuum()
            assert target.run(changed, ["k"], "v", lambda d: d) == (None if step == "_announce" and after else 2)
            assert sorted((r.k, r.v) for r in target.current().collect()) == sorted((r.k, r.v) for r in changed.collect())


def test_publishing_writes_the_change_alone(spark, tmp_path):
    target = VersionedTarget(spark, str(tmp_path / "t"), ["k"])
    target.publish(spark.range(50_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "t").rglob("*.parquet"))
    first = size()
    target.publish_change(spark.createDataFrame([(7, "new")], "k bigint, v string"), spark.createDataFrame([(7,), (8,)], "k bigint"))
    assert size() - first < first / 100 and target.current().count() == 49_999 and target.current().where("k = 7").first().v == "new"
    other = VersionedTarget(spark, str(tmp_path / "t"), ["k"])
    with pytest.raises(RuntimeError):  # of two runs with one number the second fails
        other._announce(2, target.manifest(1))
    running = target._write(spark.createDataFrame([(9, "x")], "k bigint, v string"), "3")
    assert other.vacuum(keep=1) == [] and target._announce(3, [*target.manifest(2), {"rows": running, "gone": None}]) is None
    assert target.current().count() == 50_000
    lost = target._write(spark.createDataFrame([(10, "x")], "k bigint, v string"), "4")
    assert lost in other.vacuum(keep=1, lease=-1)
    with pytest.raises(RuntimeError):  # its folder is gone, so it isn't published
        target._announce(4, [{"rows": lost, "gone": None}])
    assert target.versions()[-1] == 3 and target.current().count() == 50_000
