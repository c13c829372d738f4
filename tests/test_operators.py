"""Rules that SQL does not cover, against small models of them."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill import config
from tidemill.operators import conventions, gate, ingest, pages, persist, rank, retrieve
from tidemill.plans import engine
from tidemill.plans.queries import RULES
from tidemill.sources import inline
from tidemill.streaming import landing


def _one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word,stem", [("batteries", "battery"), ("glasses", "glass"), ("nuts", "nut"), ("press", "press"), ("gas", "ga"), ("as", "as")])
def test_singular(spark, word, stem):
    assert _one(spark, T.singular(F.col("w")), w=word) == (stem if len(word) > 3 else word if word != "gas" else "gas")


def test_tokens_and_phrases(spark):
    q = "What are the top-clearance limits, 0.10 mm or 5, for pistons?"
    tokens = _one(spark, T.content_tokens(F.col("q")), q=q)
    assert tokens == ["top", "clearance", "limit", "0.10", "mm", "piston"]
    assert _one(spark, T.phrases(T.content_tokens(F.col("q"))), q="valve cover nuts torque")[:3] == ["valve cover", "cover nut", "nut torque"]
    assert _one(spark, T.phrases(T.content_tokens(F.col("q"))), q="valve") == []
    assert _one(spark, T.content_tokens(F.col("q")), q="") == []


def test_models_agree(spark):
    for a, b, want in (("FP120", "fp-120 mk2", True), ("", "x", True), ("AC77", "FP120", False), ("XABCDEY", "ZABCDEQ", True), (None, "x", True)):
        assert _one(spark, T.models_agree(F.col("a").cast("string"), F.col("b").cast("string")), a=a, b=b) is want


def test_table_cells_and_json(spark):
    assert _one(spark, T.table_cells(F.col("j")), j='{"grid":[[{"text":"a"},{"text":"a"}],[{"text":" b "},{"text":""}]]}') == "a | b"
    assert _one(spark, T.table_cells(F.col("j")), j="not json") is None
    assert _one(spark, T.table_cells(F.col("j")), j='{"rows":[{"text":"a \\"q\\"","cells":[{"text":"b"},{"sub":{"deep":[{"text":"b"},{"text":"c"}]}}]}]}') == 'a "q" | b | c'
    assert _one(spark, T.json_object(F.col("j"), "k int")["k"], j='```json\n{"k": 3}\n```') == 3


def test_diversify_is_the_running_cap(spark):
    r = random.Random(5)
    rows = [(1, i, r.choice(["A", "B", None]), r.choice(["list", "paragraph"]), i) for i in range(60)]
    out = rank.diversify(spark.createDataFrame(rows, "query_id long, element_id long, doc_code string, type string, place int"), limit=60).collect()
    taken, seen = set(), {}
    for _, e, code, kind, _ in rows:
        n, lists = seen.setdefault(code, [0, 0])
        if code is None or n < 3:
            taken.add(e)
            seen[code][0] += 1
        elif kind == "list":
            seen[code][1] += 1
            if 3 + seen[code][1] - 1 < 7:
                taken.add(e)
    assert {x["element_id"] for x in out if x["late"] == 0} == taken
    assert len(out) == 60


def _passes(rows, visual, limit):
    """The passes one after the other, as a loop over the ordered hits."""
    code = lambda h: (h["doc_code"] or h["procedure_no"] or "").upper()
    plate = lambda h: (h["plate_no"] or h["doc_code"] or "").upper()
    stem = lambda h: h["component_title"].lower() if h["component_title"] else ""
    out, seen, per = [], set(), {}

    def take(h):
        if h["element_id"] not in seen:
            seen.add(h["element_id"])
            out.append(h["element_id"])
            if code(h):
                per[code(h)] = per.get(code(h), 0) + 1

    if visual:
        figs = sorted((h for h in rows if h["image"] or h["kind"] == "plate" or h["drawing_code"]), key=lambda h: (not h["image"], not h["pinned"], h["rule"] != "exact identifier", -h["score"], h["place"]))
        for h in [x for x in figs if x["image"]][:6]:
            take(h)
        for h in [x for x in figs if not x["image"]]:
            if len(out) < 8:
                take(h)
    chosen = [h for h in rows if h["element_id"] in seen]
    want, have = {plate(h) for h in chosen if h["plate_no"] or h["kind"] == "plate"} - {""}, {plate(h) for h in chosen if h["image"]}
    for h in rows:
        if h["image"] and plate(h) in want and plate(h) not in have:
            take(h)
            have.add(plate(h))
    stems = list(dict.fromkeys(stem(h) for h in rows if stem(h)))[:4]
    done = set()
    for h in rows:
        if stem(h) in stems and h["kind"] in ("data", "procedure", "schedule") and (stem(h), h["kind"]) not in done:
            done.add((stem(h), h["kind"]))
            take(h)
    for h in rows:
        n = per.get(code(h), 0)
        if h["element_id"] not in seen and (not code(h) or n < 3 or (h["type"] == "list" and n < 7)):
            take(h)
    for h in rows:
        take(h)
    return out[:limit]


def test_passes_are_the_sequential_rule(spark):
    r, rows = random.Random(8), []
    kinds = "query_id long, element_id long, place int, type string, kind string, component_title string, doc_code string, procedure_no string, plate_no string, drawing_code string, image string, pinned boolean, rule string, score double"
    pick = lambda *x: r.choice(x)
    for q in range(1, 31):
        for n in range(40):
            rows.append((q, q * 1000 + n, n + 1, pick("list", "paragraph"), pick("data", "procedure", "plate", "schedule", None), pick("Rotor", "Cover", "Pump", "Casing", "Shaft", None), pick("D1", "M1", "P1", None), pick("301-1", None), pick("P9", None, None), pick("X1", None, None), pick("a.png", None, None), pick(True, False), pick("exact identifier", None, None), float(40 - n)))
    df = spark.createDataFrame(rows, kinds)
    questions = spark.createDataFrame([(q, "m", "show me it" if q % 2 else "tell me") for q in range(1, 31)], "query_id long, manual_id string, text string")
    got = rank.diversify_passes(df, questions).collect()
    names = [c.split()[0] for c in kinds.split(", ")]
    for q in range(1, 31):
        own = [dict(zip(names, x, strict=True)) for x in rows if x[0] == q]
        assert [x["element_id"] for x in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["place"])] == _passes(own, q % 2 == 1, 24)


def test_rrf_ties_and_limits(spark):
    a = spark.createDataFrame([(1, 10, 5.0), (1, 11, 4.0)], "query_id long, element_id long, score double")
    b = spark.createDataFrame([(1, 11, 9.0), (1, 10, 1.0)], "query_id long, element_id long, score double")
    got = {r["element_id"]: r["score"] for r in retrieve.rrf([a, b]).collect()}
    assert got[10] == got[11] == round(1 / 61 + 1 / 62, 9)
    assert retrieve.rrf([a, b], limit=1).first()["element_id"] == 10


def test_panels(spark):
    boxes = {(r["manual_id"], r["page"], r["panel"]): (r["x0"], r["y0"]) for r in RULES["panel_boxes"](inline.Inline(spark)).collect()}
    # page 1 of another manual is another page
    assert boxes == {("m1", 1, 0): (50.0, 50.0), ("m1", 1, 1): (310.0, 50.0), ("m1", 1, 2): (50.0, 420.0), ("m1", 2, 0): (100.0, 100.0), ("m2", 1, 0): (0.0, 0.0)}
    codes = {(r["manual_id"], r["page"], r["panel"]): r["code"] for r in RULES["panel_codes"](inline.Inline(spark)).collect()}
    assert codes == {("m1", 1, 0): "AB1-1", ("m1", 1, 1): "AB1-2", ("m1", 1, 2): "AB1-3", ("m1", 2, 0): "AB2-1", ("m2", 1, 0): "ZZ9-9"}


def _gate(spark, question, evidence, model="FP120", equipment=None):
    q = spark.createDataFrame([(1, "m", question, equipment)], "query_id long, manual_id string, text string, equipment string")
    e = spark.createDataFrame([(i, "m", "paragraph", 1, t, None, "301-1", None, "A2", None, None) for i, t in enumerate(evidence)], inline.TABLES["elements"][0].replace("section_id long, ", ""))
    hits = e.select(F.lit(1).cast("long").alias("query_id"), "element_id")
    return gate.checks(q, hits, e, spark.createDataFrame([("m", model)], "manual_id string, model string")).first()


def test_gate(spark):
    assert "scope" in _gate(spark, "torque of nuts", [])["failed"]
    r = _gate(spark, "tightening torque of the nuts", ["Tightening torque of nuts is 45 Nm"], equipment="AC77")
    assert not r["passed"] and r["failed"] == ["equipment"]
    r = _gate(spark, "tightening torque of the nuts", ["Tightening torque of nuts is 45 Nm"], equipment="FP120")
    assert r["passed"] and r["failed"] == [] and r["reason"] == "ok"
    # an edition without a number says nothing; with one, evidence of that number must have it
    assert _gate(spark, "tightening torque of the nuts, edition B9", ["tightening torque of nuts"])["failed"] == []
    assert _gate(spark, "tightening torque of the nuts in 301-1, edition B9", ["tightening torque of nuts"])["failed"] == ["revision"]
    assert _gate(spark, "tightening torque of the nuts in 301-1, edition A2", ["tightening torque of nuts"])["failed"] == []
    assert _gate(spark, "gap in mm of the rotor", ["rotor gap"])["failed"] == ["units"]
    assert _gate(spark, "rotor gap at 85 % MCR", ["rotor gap"])["failed"] == ["condition"]
    assert _gate(spark, "rotor gap at 85 % MCR", ["rotor gap at 85% mcr"])["failed"] == []


def test_ask_answers_or_abstains(spark):
    rows = {r["query_id"]: r for r in RULES["ask"](inline.Inline(spark)).collect()}
    assert len(rows) == 7
    assert rows[1]["passed"] and "45 Nm" in rows[1]["answer"]
    assert rows[4]["abstained"] and rows[5]["abstained"]


def test_page_helpers(spark):
    p = spark.range(1, 11).select(F.lit("m").alias("manual_id"), F.col("id").cast("int").alias("page"))
    assert sorted(r["page"] for r in pages.selected(p, "1-3,7,9-99").collect()) == [1, 2, 3, 7, 9, 10]
    hundred = spark.range(1, 101).select(F.lit("m").alias("manual_id"), F.col("id").cast("int").alias("page"), F.when(F.col("id") == 60, 9).otherwise(1).alias("drawings"))
    assert sorted(r["page"] for r in conventions.sampled(hundred, 3).collect()) == [1, 51, 60]
    layout = '{"texts":[{"label":"section_header","text":" A  b ","page":1,"bbox":{"l":1,"t":2.005,"r":3,"b":4}}],"tables":[{"grid":[[{"text":"x"}]],"page":2}],"pictures":[{"page":1,"bbox":{"x0":0,"y0":0,"x1":5,"y1":6},"caption":"Pump"}]}'
    df = spark.createDataFrame([("m", layout)], "manual_id string, layout string")
    got = [(r["type"], r["page"], r["text"], r["bbox"]) for r in ingest.layout_elements(df).collect()]
    assert got == [("heading", 1, "A b", [1.0, 2.0, 3.0, 4.0]), ("table", 2, None, None), ("figure", 1, "Pump", [0.0, 0.0, 5.0, 6.0])]
    sent = spark.createDataFrame([("m", 1, 17), ("m", 2, 40)], "manual_id string, nth int, page int")
    assert {r["page"] for r in ingest.layout_elements(df, sent).collect()} == {17, 40}
    answers = spark.createDataFrame([("m", 1, 1, "CODE: AB12\nSTEP: 4"), ("m", 1, 2, "see AB1234-5\n 3. turn")], "manual_id string, page int, panel int, answer string")
    assert [(r["code"], r["step"]) for r in ingest.panel_ocr(answers).collect()] == [("AB12", 4), ("AB1234-5", 3)]


def test_ocr_answers(spark):
    typed = '{"blocks":[{"type":"title","content":" Pump ","bbox":"{\\"l\\":1,\\"t\\":2,\\"r\\":3,\\"b\\":4}"},{"type":"text","content":" "},{"type":"table","content":"| a |"}],"markdown":"# Pump\\nFigure 7 shows it"}'
    plain = '{"markdown":"# Head\\n\\n- one\\n- two\\n\\n| a | b |\\n\\nwords"}'
    df = spark.createDataFrame([("m", 1, typed), ("m", 2, plain), ("m", 3, "no json")], "manual_id string, page int, answer string")
    got = sorted(((r["page"], r["nth"], r["type"], r["text"], r["bbox"]) for r in pages.ocr_elements(df).collect()), key=str)
    big = 1 << 20
    assert got == sorted([(1, 0, "heading", "Pump", [1.0, 2.0, 3.0, 4.0]), (1, 2, "table", "| a |", None), (1, big, "figure", "Figure 7 shows it", None), (2, 0, "heading", "Head", None), (2, 1, "list", "- one\n- two", None), (2, 2, "table", "| a | b |", None), (2, 3, "paragraph", "words", None), (2, big, "figure", "Head", None), (3, big, "figure", "Page 3", None)], key=str)


def test_conventions_are_data(spark):
    """A number that a manual never seen before uses, references in its own words, and answers of a service."""
    own = spark.createDataFrame([("x", "citation_key", r"DWG-[0-9]+", None, "per_document", ["drawing"], False, "heuristic")], conventions.SCHEMA)
    text = spark.createDataFrame([("x", 3, "See Drawing DWG-4471 in Chapter 7"), ("y", 4, "page 9")], "manual_id string, page int, text string")
    got = {r["manual_id"]: r for r in conventions.citations(text, own).collect()}
    assert got["x"]["key"] == "DWG-4471" and got["x"]["revision"] is None and got["y"]["key"] == "p.9"
    bad = spark.createDataFrame([("x", "("), ("x", None), ("x", "a+")], "manual_id string, pattern string")
    assert [r["pattern"] for r in conventions.usable(bad).collect()] == ["a+"]
    fresh = own.withColumn("pattern", F.lit("N[0-9]"))
    stored = own.unionByName(own.withColumn("manual_id", F.lit("z")))
    assert {(r["manual_id"], r["pattern"]) for r in conventions.updated(stored, fresh).collect()} == {("x", "N[0-9]"), ("z", "DWG-[0-9]+")}


def test_panel_pages(spark):
    rows = {(r["manual_id"], r["page"], r["panel"]): r for r in RULES["diagram_elements"](inline.Inline(spark)).collect()}
    assert set(rows) == {("m1", 1, None), ("m1", 1, 0), ("m1", 1, 1), ("m1", 1, 2), ("m1", 2, 0), ("m1", 3, None), ("m2", 1, 0)}
    assert rows["m1", 1, 0]["code"] == "AB1-1" and rows["m1", 1, 0]["step"] == 1  # over what OCR read
    assert rows["m1", 1, 0]["caption"] == "Rotor - Mounting - step 1 - AB1-1" and rows["m1", 3, None]["figure_ref"] == "page-3"
    assert rows["m1", 1, None]["type"] == "paragraph" and rows["m1", 1, None]["text"].startswith("A text")
    kept = sorted((r["page"], r["type"], r["caption"]) for r in RULES["attached_panels"](inline.Inline(spark)).where("caption is not null").collect())
    assert kept == [(1, "figure", f"Rotor - Mounting - step {k} - AB1-{k}") for k in (1, 2, 3)] + [(3, "plate", "plate"), (9, "figure", "alone")]
    plates = {(r["manual_id"], r["page"]): (r["text"], r["citation_key"]) for r in RULES["completed_plates"](inline.Inline(spark)).collect()}
    assert plates == {("m1", 5): ("P30150", "P30150"), ("m1", 21): ("Rotor - P30201", "P30201"), ("m2", 2): ("P99001", "P99001")}


def test_writers(spark, tmp_path):
    d = str(tmp_path / "corpus")
    manual = spark.createDataFrame([("m", "Pump", "A1", None)], "manual_id string, title string, revision string, effective date")
    persist.append_manual(manual, d)
    persist.append_manual(manual.withColumn("manual_id", F.lit("n")), d)
    assert spark.read.parquet(f"{d}/manuals").count() == 2 and spark.read.parquet(f"{d}/manual_revisions").where("label = 'A1' and superseded_by is null").count() == 2
    for run, status in (("r1", "running"), ("r1", "completed"), ("r2", "running")):
        persist.append_run(persist.run_event(spark, run, None if run == "r2" else "m", status, {"text": 3}), d)
    assert {(r["run_id"], r["status"]) for r in persist.run_states(spark.read.parquet(f"{d}/ingest_runs")).collect()} == {("r1", "completed"), ("r2", "running")}
    persist.append_log(RULES["query_log"](inline.Inline(spark)), d)
    assert spark.read.parquet(f"{d}/query_log").count() == 7
    persist.write_routes(RULES["route_pages"](inline.Inline(spark)), d)
    assert spark.read.json(f"{d}/page_routes").count() == 18
    assert persist.listing(spark, f"{d}/page_routes", "*.json").where("length > 0").count() >= 2
    assert persist.clear(spark, d, "page_routes") and not persist.clear(spark, d, "page_routes")
    persist.recreate(spark, d, {"manuals": "manual_id string, title string"})
    assert spark.read.parquet(f"{d}/manuals").count() == 0


def test_pdf_pages_are_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << /Type /Pages /Count 2 >>\n<< /Type /Page >>\n<</Type/Page/Parent 1 0 R>>\n\xff\xfe")
    (tmp_path / "in" / "b.pdf").write_bytes(b"no pdf /Type /Page ")
    (tmp_path / "c.txt").write_bytes(b"%PDF-")
    assert {r["path"].rsplit("/", 1)[1]: r["pages"] for r in pages.pdf_files(spark, str(tmp_path)).collect()} == {"a.pdf": 2, "b.pdf": None}


def test_settings_by_name():
    s = config.Settings.of({"tidemill.fused": "12", "other": "x"})
    assert s.fused == 12 and s.rrf_k == 60


def test_edges_are_built_once(spark):
    k = engine.Knowledge(*[inline.Inline(spark)(n) for n in ("manuals", "sections", "elements", "figures", "edges")])
    rows = engine.build_edges(k).collect()
    assert len(rows) == len(set(rows)) > 0
    again = engine.build_edges(engine.Knowledge(k.manuals, k.sections, k.elements, k.figures, k.edges.unionByName(engine.build_edges(k))))
    assert again.count() == 0


def test_stream_routes_each_page(spark, tmp_path):
    inline.Inline(spark)("pages").repartition(3).write.parquet(str(tmp_path / "in"))
    landing.route_stream(landing.landing(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 18
