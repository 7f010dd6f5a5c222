from datetime import datetime, timedelta

import pytest

from lutrin import cli, config, service
from lutrin.operators import encoders
from lutrin.operators.ledger import Fenced, Ledger
from lutrin.plans.build import build, cache_plan, patch_families
from lutrin.sources import files
from lutrin.sources.store import Store
from lutrin.streaming.ingest import watch

LISTED = "source_path string, size_bytes long, modified_time double"


def test_cache_plan(spark):
    listed = spark.createDataFrame([("same", 1, 1.0), ("size", 2, 1.0), ("time", 1, 2.0), ("new", 1, 1.0), ("empty", 1, 1.0), ("lost", 1, 1.0)], LISTED)
    manifest = spark.createDataFrame([("same", 1, 1.0, 1), ("size", 1, 1.0, 1), ("time", 1, 1.0, 1), ("gone", 1, 1.0, 1), ("empty", 1, 1.0, 0), ("lost", 1, 1.0, 2)], LISTED + ", chunk_count int")
    stored = spark.createDataFrame([("same",), ("size",), ("time",), ("lost",)], "source_path string")
    hit = lambda *a: {r["source_path"] for r in cache_plan(listed, manifest, stored, *a).where("cached").collect()}
    assert hit() == {"same", "empty"} and hit(True) == set() and hit(True, ["annexes"]) == {"same", "empty"}


def test_ingest_ask_and_stream(spark, tmp_path):
    docs, index = tmp_path / "docs", str(tmp_path / "index")
    (docs / "Annexes").mkdir(parents=True)
    (docs / "Annexes" / "a.txt").write_text("Le mur en pierre longe la rue\fPage deux parle du toit", encoding="utf-8")
    (docs / "b.txt").write_text("Une haie borde le parc communal", encoding="utf-8")
    (docs / "bad.txt").write_bytes(b"\xff\xfe\xff")
    run = lambda *a: cli.main(["--docs", str(docs), "--index", index, "--kind", ".txt", *a], spark)
    run("ingest")
    store = Store(spark, index)
    chunks = {r["chunk_id"]: r["content"] for r in store.table("chunks").collect()}
    assert chunks == {"a-0": "Le mur en pierre longe la rue\nPage deux parle du toit", "b-0": "Une haie borde le parc communal"}
    assert store.table("manifest").where("chunk_count = 0").count() == 1
    (docs / "b.txt").unlink()
    (docs / "c.txt").write_text("Le bassin recueille la pluie", encoding="utf-8")
    run("ingest")
    assert {r["chunk_id"] for r in store.table("chunks").collect()} == {"a-0", "c-0"}
    engine = cli.Engine(spark, store, config.Settings())
    assert engine.hits("pluie bassin", 1).first()["chunk_id"] == "c-0"
    status, body = service.reply(engine, {"question": "mur en pierre"})
    assert status == 200 and body["citations"][0]["source"] == "a.txt" and service.reply(engine, {})[0] == 422
    assert {tuple(r) for r in patch_families(store, (("docs", "all"),)).collect()} == {("all", 0, 2), ("annexes", 1, 0), ("other", 1, 0)}
    (docs / "d.txt").write_text("Un verger domine la vallée", encoding="utf-8")
    read = lambda wanted: files.pages(spark, str(docs), wanted, files.plain_pages, "*.txt").where("error IS NULL")
    watch(spark, str(docs), store, read, str(tmp_path / "cp"), pattern="*.txt").awaitTermination()
    assert "d-0" in {r["chunk_id"] for r in store.table("chunks").collect()}


PAGES = "page_id long, source_path string, page_num int, text string"


def test_two_builds_never_lose_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    listed = lambda *x: spark.createDataFrame([(p, n, 1.0) for p, n in x], LISTED)
    texts = {"a": "le mur de pierre", "b": "la haie du parc", "c": "le toit de zinc"}
    pages = lambda todo: spark.createDataFrame([(i, r["source_path"], 1, texts[r["source_path"]]) for i, r in enumerate(todo.collect())], PAGES)
    have = lambda: {r["source_path"] for r in store.table("chunks").collect()}
    assert build(store, listed(("a", 1)), pages) == (1, 1)

    def overtaken(todo):  # while this build reads its pages, another one takes and publishes a new file
        if {r["source_path"] for r in todo.collect()} == {"b"}:
            build(store, listed(("a", 1), ("b", 1), ("c", 1)), pages)
        return pages(todo)

    with pytest.raises(Fenced):
        build(store, listed(("a", 1), ("b", 1)), overtaken)
    assert have() == {"a", "c"}  # b was leased by the build that was overtaken
    now = datetime.now() + timedelta(hours=2)  # its lease runs out
    build(store, listed(("a", 1), ("b", 1), ("c", 1)), pages, clock=lambda: now)
    assert have() == {"a", "b", "c"} and {r["state"] for r in Ledger(store).items().collect()} == {"done"}

    def broken(todo):
        raise OSError("disk")

    with pytest.raises(OSError):
        build(store, listed(("a", 2)), broken)
    assert have() == {"a", "b", "c"}
    read = []
    build(store, listed(("a", 2), ("b", 1)), lambda todo: read.extend(r[0] for r in todo.collect()) or pages(todo))  # given back, so taken at once
    assert read == ["a"] and have() == {"a", "b"}


def test_tidy_keeps_what_is_named(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for i in range(4):
        store.write({"t": spark.range(i + 1), **({"u": spark.range(9)} if not i else {})})
    assert store.tidy() == [] and store.table("t").count() == 4
    gone = store.tidy(keep=1, age_seconds=-1)
    assert len([g for g in gone if g.endswith(".version")]) == 3 and store.table("t").count() == 4 and store.table("u").count() == 9


def test_missing_index_and_bad_arguments(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "no")).table("chunks", True)
    with pytest.raises(ValueError):
        cli.main(["ingest", "--family", "x"], spark)
    with pytest.raises(RuntimeError):
        build(Store(spark, str(tmp_path / "no")), spark.createDataFrame([], LISTED), lambda w: spark.createDataFrame([], "page_id long, source_path string, page_num int, text string"))


def test_settings_and_encoder(spark):
    assert config.load({"LUTRIN_MAX_FILES": "3"}, top_k=7) == config.Settings(max_files=3, top_k=7)
    df = spark.createDataFrame([(1, "a b"), (2, None)], "i int, t string")
    rows = {r["i"]: r["embedding"] for r in encoders.encode(df, "i", "t", encoders.HashedWords(8)).collect()}
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-5 and set(rows[2]) == {0.0}
