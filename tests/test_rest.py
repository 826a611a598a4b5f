import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brute import cut_text
from lexivane import LexicalEngine
from lexivane.operators import append as A
from lexivane.operators import cascade as CA
from lexivane.operators import catalog as C
from lexivane.operators import expand as E
from lexivane.operators import index as I
from lexivane.operators import mining as M
from lexivane.operators import queries as Q
from lexivane.plans.store import TableStore
from lexivane.sources import base_json as J
from lexivane.sources import thesaurus as TH
from lexivane.sources import vocabulary as V
from lexivane.streaming.appends import ChunkLog, append_stream, in_order
from lexivane.streaming.mining_cycles import KnowledgeStore, run_cycle

ROWS = "collection string, base string, doc long, text string"


@pytest.fixture(scope="module")
def index(spark):
    rows = [("c", "a", 0, "casa verde OE-6016 casa"), ("c", "b", 0, "porta azul da montanha"), ("d", "x", 0, "livro grande")]
    return I.build_index(spark.createDataFrame(rows, ROWS), TableStore(spark))


def test_base_syllabary(spark):
    rows = V.base_syllabary(spark).orderBy("dim").collect()
    assert len(rows) == 1956 and [r["token"] for r in rows[:4]] == ["ba", "be", "bi", "bo"]
    assert len({r["token"] for r in rows}) == 1956


def test_driver_files(spark, tmp_path):
    derived = V.derive_driver(V.base_syllabary(spark), "Toy", ["Let", "in", "let"])
    lines = [r["value"] for r in V.driver_lines(derived, "driver: Toy", "toy language", [".toy"]).collect()]
    (tmp_path / "tokens_Toy_PTBR.drv").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "tokens_PTBR.drv").write_text("# driver: PTBR\n# extensoes: .txt\nca\nsa\n", encoding="utf-8")
    vocab, meta = V.read_drivers(spark, str(tmp_path))
    toy = V.list_drivers(vocab, meta, "To*").first()
    assert (toy["syllables"], toy["keywords"], toy["vocab_size"], toy["extensions"]) == (1956, 2, 1958, [".toy"])
    asked = spark.createDataFrame([("a/b.TOY",), ("c.zzz",)], "path string")
    got = {r["path"]: (r["matched"], r["language"]) for r in V.interpret(asked, meta).collect()}
    assert got == {"a/b.TOY": (True, "Toy"), "c.zzz": (False, "PTBR")}


def fold(texts, size):
    state = []
    for text in texts:
        at, head = (state[-1][0], state[-1][1]) if state else (0, "")
        state = state[:-1] + [(at + o, p) for o, p in cut_text(head + text, size)]
    return state


def test_append_packs_in_order(spark):
    texts = {"x": ["um dois tres", " quatro cinco", "seis sete oito nove"], "y": ["a" * 25, "b c d"], "z": [" ", "so"]}
    rows = [("c", b, i, t) for b, listed in texts.items() for i, t in enumerate(listed)]
    df = spark.createDataFrame(rows, "collection string, base string, seq long, text string")
    got = A.packed_chunks(df, size=10).orderBy("base", "chunk").collect()
    for base, listed in texts.items():
        assert [(r["start"], r["text"]) for r in got if r["base"] == base] == fold(listed, 10)


def test_drivers_are_installed_as_versions(spark, tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "tokens_Rust_PTBR.drv").write_text("# Rust\n# extensoes: .rs\nfa\nlar\n=fn\n")
    engine = LexicalEngine(spark, str(tmp_path / "root"))
    files = engine.add_drivers(str(folder))
    assert [tuple(r) for r in files.select("file", "installed").collect()] == [("tokens_Rust_PTBR.drv", False)]
    routed = lambda: [(r["matched"], r["language"]) for r in V.interpret(spark.createDataFrame([("a.rs",), ("b",)], "path string"), engine.driver_catalog.meta()).orderBy("path").collect()]
    assert routed() == [(False, "PTBR"), (False, "PTBR")]
    engine.ingest(spark.createDataFrame([("c", "x", 0, "casa verde")], ROWS))
    assert engine.install_driver("tokens_Rust_PTBR.drv") == 1
    assert routed() == [(True, "Rust"), (False, "PTBR")]
    engine.ingest(spark.createDataFrame([("c", "y", 0, "fala lar", "Rust")], f"{ROWS}, driver string"))
    tokens = engine.index.postings.where("base = 'y'").select("token", "dim").distinct().collect()
    assert sorted(tuple(r) for r in tokens) == [("fa", 0), ("lar", 1)]
    before = engine.driver_catalog.files()
    assert engine.uninstall_driver("tokens_Rust_PTBR.drv") == 0
    assert routed() == [(False, "PTBR"), (False, "PTBR")] and before.where("installed").count() == 1
    for file, error in (("../x.drv", ValueError), (V.FALLBACK_FILE, ValueError), ("tokens_Rust_PTBR.drv", FileNotFoundError)):
        with pytest.raises(error):
            engine.uninstall_driver(file)


def test_first_chunks_of_a_base(spark, tmp_path):
    rows = [("c", "x", d, f"um dois tres quatro {d}") for d in range(5)] + [("c", "y", 0, "so"), ("c", "y", 1, None)]
    index = I.build_index(spark.createDataFrame(rows, ROWS), TableStore(spark), 10, max_chunks=4)
    every = I.build_index(spark.createDataFrame(rows, ROWS), TableStore(spark), 10)
    wanted = ["chunk", "start", "text"]
    listed = lambda i, base: sorted(tuple(r) for r in i.numbered(i.chunks.where(F.col("base") == base)).select(*wanted).collect())
    assert listed(index, "x") == listed(every, "x")[:4] and listed(index, "y") == listed(every, "y")
    sizes = lambda i: sorted(tuple(r) for r in i.bases.select("base", "bytes").collect())
    assert sizes(index) == sizes(every)
    engine = LexicalEngine(spark, str(tmp_path / "limits"), 10, max_bases=2, max_chunks_per_base=4)
    docs = spark.createDataFrame(rows, ROWS)
    with pytest.raises(ValueError, match="c/x has"):
        engine.ingest(docs)
    engine.ingest(docs, max_chunks=4)
    with pytest.raises(ValueError, match="more than 2 bases"):
        engine.ingest(spark.createDataFrame([("c", "z", 0, "so")], ROWS))
    assert engine.health()["bases"] == 2


def test_append_leaves_other_chunks(spark):
    old = spark.createDataFrame([("c", "x", 0, 0, "um dois"), ("c", "x", 1, 8, "tres"), ("c", "y", 0, 0, "so")], "collection string, base string, chunk int, start int, text string")
    new = spark.createDataFrame([("c", "x", 0, " quatro")], "collection string, base string, seq long, text string")
    got = sorted(tuple(r) for r in A.append_rows(old, new, 8).select("base", "chunk", "start", "text").collect())
    assert got == [("x", 0, 0, "um dois"), ("x", 1, 8, "tres"), ("x", 2, 13, "quatro"), ("y", 0, 0, "so")]


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("c", "x", 0, "um dois tres"), ("c", "x", 1, " quatro cinco"), ("c", "y", 0, "so isto")]
    schema = "collection string, base string, seq long, text string"
    log = ChunkLog(TableStore(spark))
    for i in (0, 1):
        part = spark.createDataFrame([r for r in rows if r[2] == i], schema)
        part.write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        append_stream(stream, log, str(tmp_path / "state"), 10).awaitTermination()
    want = A.packed_chunks(spark.createDataFrame(rows, schema), size=10).select("base", "chunk", "start", "text")
    got = log.current().select("base", "chunk", "start", "text")
    assert sorted(got.collect()) == sorted(want.collect())


def test_stream_state_holds_open_chunks_only(spark, tmp_path):
    schema = "collection string, base string, seq long, text string"
    log = ChunkLog(TableStore(spark))
    rows = [[(None, "x", i, f"wort{i} und mehr ") for i in range(lot * 20, lot * 20 + 20)] + [("c", "y", lot, None if lot == 1 else "so ")] for lot in range(3)]
    for lot in rows:
        spark.createDataFrame(lot[::-1], schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        append_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), log, str(tmp_path / "state"), 30).awaitTermination()
        state = spark.read.format("statestore").load(str(tmp_path / "state"))
        assert state.count() == 2
    want = A.packed_chunks(spark.createDataFrame(sum(rows, []), schema), size=30).select("base", "chunk", "start", "text").collect()
    assert sorted(log.current().select("base", "chunk", "start", "text").collect()) == sorted(want)
    # batches write what they changed
    assert log.rows().where("batch = 2 and base = 'x' and chunk < 5").count() == 0


def test_rows_in_order_beyond_the_held_letters():
    frames = [pd.DataFrame({"seq": list(range(i, 40, 4))[::-1], "text": [f"t{n}" for n in range(i, 40, 4)][::-1]}) for i in range(4)]
    for held in (1, 7, 1000):
        assert list(in_order(frames, held)) == [(n, f"t{n}") for n in range(40)]


def test_mining_skips_unchanged(spark, index):
    knowledge = KnowledgeStore(TableStore(spark))
    assert run_cycle(index, knowledge, 0, ["c"]).count() == 1
    assert M.mine(index, knowledge.current(), ["c"]).count() == 0
    assert M.mine(index, knowledge.current(), ["c"], force=True).count() == 1
    run_cycle(index, knowledge, 1)
    assert {r["collection"] for r in knowledge.current().collect()} == {"c", "d"}
    assert sorted((r["base"], r["cycle"], len(r["vec"])) for r in knowledge.anatomy().collect() if r["collection"] == "c")[0][:2] == ("a", 0)
    assert knowledge.anatomy().count() == 3
    item = M.filter_knowledge(knowledge.current(), "d", "RootIndex", 0).first()["knowledge"][0]
    assert json.loads(item["content"])["n_bases"] == 1


def test_expansion_order_and_limits(spark):
    queries = Q.query_frame(spark, ["casa do porta"])
    syn = spark.createDataFrame([("casa", ["Lar", "casa", "lar", " morada "]), ("do", ["act"]), ("porta", ["entrada"] + [f"p{i}" for i in range(20)])], "w string, s array<string>")
    got = [r["variant"] for r in E.dictionary_expansions(queries, syn).orderBy("variant_no").collect()]
    assert got[:3] == ["Lar", "morada", "entrada"] and len(got) == 12
    cache = spark.createDataFrame([("casa do porta", ["x", "y"])], "query_key string, variants array<string>")
    both = E.expansions(queries, syn, cache).select("source").distinct().collect()
    assert [r["source"] for r in both] == ["dict"]
    assert E.expansions(Q.query_frame(spark, ["Casa  do porta"]), None, cache).count() == 2


def test_cascade_learns_what_the_expander_found(spark, index):
    asked = []

    def expander(left):
        asked.append(sorted(r["query"] for r in left.collect()))
        return left.where("query like 'casa%'").select("query_id", F.lit(1).alias("variant_no"), F.lit("porta").alias("variant"))

    cache = CA.ExpansionCache(TableStore(spark))
    syn = spark.createDataFrame([("porta", ["casa", "zzzz"])], "w string, s array<string>")
    queries = ["Casa  verde", "porta", "casa verde", "nada 77-x", "nada"]
    first = CA.cascade(index, queries, syn, cache, expander)
    sources = lambda got: [r["source"] for r in got.outcome.orderBy("query_id").collect()]
    # the expander is asked by one query text as it stands, and only for what dictionaries left
    assert asked == [["Casa  verde", "casa verde", "nada", "nada 77-x"]]
    assert sources(first) == ["none", "dict", "custom", "none", "none"]
    second = CA.cascade(index, queries, syn, cache)
    assert sources(second) == ["cache", "dict", "cache", "none", "none"]
    assert cache.current().count() == 1
    cache.upsert(spark.createDataFrame([("casa verde", ["morada"]), ("nada", ["casa"])], "query_key string, variants array<string>"))
    assert {r["query_key"]: r["variants"] for r in cache.current().collect()} == {"casa verde": ["morada"], "nada": ["casa"]}
    nothing = CA.cascade(index, Q.query_frame(spark, ["x"]).where("false"), syn, cache)
    assert nothing.outcome.count() == 0 and nothing.hits.count() == 0


def test_absence_and_suggestions(spark, index):
    queries = Q.query_frame(spark, ["montanya", "casa", "montana"])
    rows = {r["query_id"]: r for r in E.absence_report(index, queries, E.expansions(queries)).collect()}
    assert not rows[1]["absent"]
    near = E.suggest_terms(index, spark.createDataFrame([(0, "muntanha")], "query_id long, term string")).orderBy("rank").first()
    assert near["word"] == "montanha"


def test_literal_fallback(index):
    row = E.literal_fallback(index, "ticket oe-6016 or 77").first()
    assert row["base"] == "a" and row["coverage"] == 0.5 and row["needles_matched"] == ["oe-6016"]


def test_expanded_search(spark, index):
    syn = spark.createDataFrame([("lar", ["casa"])], "w string, s array<string>")
    rows = E.search_expand(index, ["lar montanha"], syn).orderBy("rank").collect()
    assert rows[0]["base"] == "b" and rows[0]["via"] == "original"


def test_limits(index):
    C.check_limits(index, 3, 1)
    with pytest.raises(ValueError):
        C.check_limits(index, 2)


def test_json_contract_round_trip(spark, index, tmp_path):
    for row in J.export_bases(index, 100).collect():
        folder = tmp_path / row["collection"]
        folder.mkdir(exist_ok=True)
        (folder / f"{row['base']}-tokenized.json").write_text(row["json"], encoding="utf-8")
    with pytest.raises(ValueError):
        J.export_bases(index, 0 or 1) and C.check_limits(index, 1)
    back = J.import_bases(J.read_bases(spark, str(tmp_path)), TableStore(spark))
    from lexivane.operators import search as S

    pick = lambda ix: [(r["base"], r["chunk"], round(r["cos"], 5), r["coverage"]) for r in S.search(ix, "casa verde", collection="c", k=3).orderBy("rank").collect()]
    assert pick(back) == pick(index)
    assert {r["base"]: r["vocab_used"] for r in back.bases.collect()} == {r["base"]: r["vocab_used"] for r in index.bases.collect()}


def test_inline_base(spark):
    doc = {
        "meta": {"corpus": "t.txt", "vocab": ["ca", "sa", "do", "lo"], "with_text": True, "n_chunks": 2},
        "idf": {"0": 0.0, "1": 0.0, "2": 0.693147},
        "chunks": [{"id": 7, "vec": {"0": 1, "1": 1}, "norm": 1.0, "text": "casa"}, {"id": 8, "vec": {"0": 1, "1": 1, "2": 1}, "norm": 0.693147, "text": "casado"}],
    }
    rows = spark.createDataFrame([("c", "b", json.dumps(doc))], "collection string, base string, json string")
    built = J.import_bases(J.parse_bases(rows), TableStore(spark))
    from lexivane.operators import search as S

    found = S.search(built, "casado").collect()
    assert [(r["chunk"], round(r["cos"], 4)) for r in found] == [(1, 1.4427)]


def test_thesaurus_parsers(spark):
    lines = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    pick = lambda df: {r["w"]: r["s"] for r in df.collect()}
    assert pick(TH.finalize(TH.parse_comma_lines(lines("House,home, house ,Dwelling,home")))) == {"house": ["home", "dwelling"]}
    assert pick(TH.finalize(TH.parse_synsets(lines("# c", "a;b (x);c")))) == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"]}
    entries = TH.parse_entries(lines("UTF-8\ncasa|2\n(s)|lar|morada (f)\n(s)|lar\nporta|1\n(s)|entrada"))
    assert pick(TH.finalize(entries)) == {"casa": ["lar", "morada"], "porta": ["entrada"]}
    bridge = TH.parse_bridge(lines('<entry><orth>home</orth><cit type="trans"><quote>lar</quote></cit></entry><entry><orth>house</orth><cit type="trans"><quote>casa</quote></cit></entry>'))
    mono = spark.createDataFrame([("house", ["home"])], "w string, s array<string>")
    assert pick(TH.compose(bridge, mono)) == {"home": ["lar"], "house": ["casa", "lar"]}


def test_dictionary_files_and_toggle(spark, tmp_path):
    data = spark.createDataFrame([("b", ["x"]), ("a", ["y", "z"])], "w string, s array<string>")
    TH.write_dictionary(data, str(tmp_path / "AA"), {"code": "AA"})
    entries = TH.read_dictionary_lines(spark, str(tmp_path / "AA" / "entries")).withColumn("code", F.lit("AA"))
    state = TH.toggle(spark.createDataFrame([("AA", False)], "code string, active boolean"), "AA", True)
    assert {r["w"] for r in TH.active_synonyms(entries, state).collect()} == {"a", "b"}
    assert TH.active_synonyms(entries, TH.toggle(state, "AA", False)).count() == 0


def test_engine_life_cycle(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.txt").write_text("casa verde", encoding="utf-8")
    engine = LexicalEngine(spark, chunk_size=16)
    engine.ingest_files(str(tmp_path), "files")
    engine.ingest_text("two", "porta azul")
    assert {(r["collection"], r["name"]) for r in engine.bases().collect()} == {("files", "sub__one_txt"), ("default", "two")}
    engine.append(spark.createDataFrame([("default", "two", 0, " montanha grande")], "collection string, base string, seq long, text string"))
    assert [r["text"] for r in engine.chunks("two", ids=[1, 0]).collect()] == ["montanha grande", "porta azul"]
    assert engine.search("montanha", base="two").first()["chunk"] == 1
    meta = engine.base("two").first()
    assert (meta["n_chunks"], meta["bytes"]) == (2, len("porta azul montanha grande"))
    dims, points = engine.histogram("montanha")
    assert dims.where("hit").count() == 3 and points.where("fraction = 1").count() == 1
    uploads = spark.createDataFrame([("up", ".name", bytearray("olá".encode()))], "collection string, name string, content binary")
    engine.ingest_uploads(uploads)
    assert engine.health() == {"ok": True, "bases": 3, "chunks": 4}
    engine.drop_collection("up")
    engine.drop_base("two")
    assert engine.health()["bases"] == 1


def test_import_adds_to_what_is_there(spark, tmp_path):
    engine = LexicalEngine(spark, str(tmp_path / "one"))
    engine.ingest_text("stored", "casa verde na montanha", "books")
    engine.export_json(str(tmp_path / "out"), 10)
    other = LexicalEngine(spark, str(tmp_path / "two"))
    other.ingest_text("mine", "porta azul da casa", "books")
    other.import_json(str(tmp_path / "out"))
    other.ingest_text("late", "mesa redonda", "books")
    assert {r["name"] for r in other.bases().collect()} == {"stored", "mine", "late"}
    for query, base in (("montanha", "stored"), ("porta azul", "mine"), ("mesa", "late")):
        assert other.search(query, collection="books", k=1).first()["base"] == base


def test_bases_with_and_without_text(spark, tmp_path):
    engine = LexicalEngine(spark, str(tmp_path / "mixed"))
    engine.ingest_text("full", "casa verde na montanha", "c")
    engine.ingest_text("bare", "casa azul na cidade", "c", with_text=False)
    assert {r["name"]: r["has_text"] for r in engine.bases("c").collect()} == {"full": True, "bare": False}
    hits = {r["base"]: r for r in engine.search("casa", collection="c", k=5).collect()}
    assert hits["full"]["coverage"] == 1.0 and hits["bare"]["coverage"] is None
    assert hits["bare"]["matchpoint"] == hits["bare"]["cos"] > 0
    engine.append(spark.createDataFrame([("c", "full", 0, " longe daqui"), ("c", "bare", 0, "longe daqui")], "collection string, base string, seq long, text string"))
    assert {r["name"]: r["has_text"] for r in engine.bases("c").collect()} == {"full": True, "bare": False}
    assert {r["base"] for r in engine.search("longe", collection="c", k=5).collect()} == {"full", "bare"}


def test_two_expanded_searches_stay_apart(spark, index):
    first = E.search_expand(index, ["casa"])
    second = E.search_expand(index, ["montanha"])
    assert first.count() and second.count()


def test_entries_of_dictionary_files(spark):
    text = "UTF-8\nabc (x)|1\n(noun)|one (hint)|two\ndef|2\n(verb)|three\n(adj)|four\n"
    rows = spark.createDataFrame([(text,), (text,)], "value string")
    got = {r["w"]: list(r["s"]) for r in TH.finalize(TH.parse_entries(rows)).collect()}
    assert got == {"abc (x)": ["one", "two"], "def": ["three", "four"]}
