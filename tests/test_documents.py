"""Parsers, chunking, files and the engine."""

import io
import json
import random
import sys
import threading
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone import __main__ as command
from siltstone import client, providers, report, service, session
from siltstone.config import Settings, SettingsError, load_settings
from siltstone.engine import Engine, ModelMismatch, Provider, load_qrels
from siltstone.operators import chunking, incremental
from siltstone.service import Refused, allowed_path, answer, authorized
from siltstone.session import scratch_path
from siltstone.functions import vectors
from siltstone.sources import corpus, files, pdf
from siltstone.sources.parsers import code, office, plain

sys.path.insert(0, str(Path(__file__).parent))
from samples import ELEMENTS, SAMPLES  # noqa: E402


def shape(parsed):
    return [(b["block_id"], b["block_type"], b["text"], b["parent_block_id"], b["ord"]) for b in parsed.blocks]


def test_markdown():
    parsed = plain.parse_markdown(SAMPLES["a.md"])
    assert parsed.extra == {"title": "Guide"}
    assert shape(parsed) == [
        ("sec_1", "section", "One", None, 1), ("p_1", "paragraph", "First line.", "sec_1", 1), ("p_2", "paragraph", "Second line.", "sec_1", 2),
        ("sec_2", "section", "Two", "sec_1", 2), ("code_1", "code_block", "code = 1", "sec_2", 1), ("sec_3", "section", "Three", None, 3),
        ("p_3", "paragraph", "Last.", "sec_3", 3),
    ]
    assert parsed.blocks[4]["hierarchy_path"] == ["doc", "sec_1", "sec_2", "code_1"]
    assert [b["block_id"] for b in plain.parse_markdown("```\n```\ntext\n```\nopen").blocks] == ["code_1", "p_1", "code_2"]
    assert shape(plain.parse_markdown("```\n"))== [] and shape(plain.parse_markdown("")) == []


def test_html():
    parsed = plain.parse_html(SAMPLES["c.html"])
    assert shape(parsed) == [
        ("sec_1", "section", "Top", None, 1), ("p_1", "paragraph", "One", "sec_1", 1), ("p_2", "paragraph", "Two bold", "sec_1", 2),
        ("li_3", "list_item", "Item", "sec_1", 3), ("li_4", "list_item", "Nested", "sec_1", 4), ("p_5", "paragraph", "Nested", "sec_1", 5),
        ("code_1", "code_block", "x = 1", "sec_1", 1),
    ]
    assert plain.parse_html("").raw_text is None


def test_text_and_structured():
    assert [b["text"] for b in plain.parse_text("a\r\n\r\n\r\n b \n\n").blocks] == ["", "a", "b"]
    assert [b["text"] for b in plain.parse_json(SAMPLES["d.json"]).blocks[1:]] == ['{"name": "x"}', '{"tags": ["a", "b"]}']
    assert [b["text"] for b in plain.parse_json("3").blocks[1:]] == ["3"]
    assert [b["text"] for b in plain.parse_yaml("- a\n- b: 1\n").blocks[1:]] == ["a\n...", "b: 1"]
    assert plain.parse_yaml("").blocks[1:] == [] and plain.parse_yaml("word").blocks[1:] == []
    assert [b["text"] for b in plain.parse_csv("a,b\n1\n").blocks[1:]] == ["a=1, b=None"]
    for bad in (lambda: plain.parse_json("{"), lambda: plain.parse_yaml("a: ["), lambda: plain.parse_csv("")):
        with pytest.raises(ValueError):
            bad()


def test_code():
    parsed = code.parse_code(SAMPLES["sub/g.py"], ".py")
    assert [(b["block_id"], b["block_type"], b["text"].split("\n")[0]) for b in parsed.blocks] == [
        ("module", "module", ""), ("sym_0", "code_container", "class A:"), ("sym_1", "code_symbol", "def f(self):"), ("sym_0_gap_0", "code_block", "x = 1"),
        ("sym_2", "code_symbol", "def g():"), ("module_gap_0", "code_block", '"""Doc."""'),
    ]
    assert json.loads(parsed.blocks[2]["metadata"])["qualified_name"] == "A.f"
    windows = code.parse_code("\n".join(f"l{i}" for i in range(120)) + "\n", ".go")
    assert [(b["block_id"], b["location"]["start_line"], b["location"]["end_line"]) for b in windows.blocks[1:]] == [("win_0", 1, 50), ("win_1", 51, 100), ("win_2", 101, 120)]
    assert code.parse_code("def broken(:\n", ".py").blocks[1]["block_id"] == "win_0"
    assert list(code.uncovered([(2, 4), (3, 6), (8, 20)], 0, 10)) == [(0, 2), (6, 8)]


def test_pdf_elements():
    assert shape(office.map_elements(ELEMENTS)) == [
        ("page_1", "page", "", None, 1), ("sec_1", "section", "Report", "page_1", 1), ("p_1", "paragraph", "Body.", "sec_1", 1),
        ("tbl_1", "table", "", "sec_1", 1), ("tbl_1_row_0", "table_row", "a b", "tbl_1", 0), ("page_2", "page", "", None, 2),
        ("li_1", "list_item", "first", "page_2", 1), ("fig_1", "figure", "a figure", "page_2", 1), ("sec_2", "section", "Second", "page_2", 2),
        ("p_2", "paragraph", "after", "sec_1", 2),
    ]
    assert office.map_elements(ELEMENTS).blocks[2]["location"]["bbox"] == [1, 2, 5, 9]


def archive(**parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return data.getvalue()


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Title", "H1") + p("Body") + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>" + p(" ")
    styles = f'<w:styles {w}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    parsed = office.parse_docx(archive(**{"word__document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word__styles.xml": styles}))
    assert shape(parsed) == [("sec_1", "section", "Title", None, 1), ("p_1", "paragraph", "Body", "sec_1", 1), ("row_1", "table_row", "a | b", "sec_1", 1)]
    with pytest.raises(ValueError):
        office.parse_docx(b"no")


def test_pptx():
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    text = lambda t: f"<p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody>"
    sp = lambda t, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr>{text(t)}</p:sp>"
    table = "<p:graphicFrame><a:tbl><a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in "xy") + "</a:tr></a:tbl></p:graphicFrame>"
    tree = lambda inner: f"<p:cSld><p:spTree>{inner}</p:spTree></p:cSld>"
    parsed = office.parse_pptx(archive(**{
        "ppt__presentation.xml": f'<p:presentation {a}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt___rels__presentation.xml.rels".replace("ppt___rels", "ppt/_rels"): f'<Relationships><Relationship Id="r1" Type="{rel}/slide" Target="slides/s1.xml"/></Relationships>',
        "ppt__slides__s1.xml": f"<p:sld {a}>{tree(sp('Top', '<p:ph type=' + chr(34) + 'title' + chr(34) + '/>') + sp('Shape') + table)}</p:sld>",
        "ppt/slides/_rels/s1.xml.rels": f'<Relationships><Relationship Id="n" Type="{rel}/notesSlide" Target="../notes/n1.xml"/></Relationships>',
        "ppt__notes__n1.xml": f"<p:notes {a}>{tree(sp('Said', '<p:ph type=' + chr(34) + 'body' + chr(34) + ' idx=' + chr(34) + '1' + chr(34) + '/>'))}</p:notes>",
    }))
    assert shape(parsed) == [
        ("slide_1", "slide", "Top", None, 1), ("slide_1_shape_1", "shape", "Shape", "slide_1", 1), ("slide_1_row_0", "table_row", "x | y", "slide_1", 2),
        ("slide_1_notes", "note", "Said", "slide_1", 3),
    ]


# -- chunking


def test_split_text_keeps_limits():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "a", ". ", "; ", "\n", "\n\n", "x" * 30]) for _ in range(rng.randint(1, 80)))
        parts = chunking.split_text(text, 60, 0, 0)
        assert "".join(parts) == text and all(len(p) <= 60 for p in parts)
        assert all(len(p) <= 60 for p in chunking.split_text(text, 60, 15, 10))


def test_split_text_named_cases():
    assert chunking.split_text("", 5) == [] and chunking.split_text("abc", 5) == ["abc"]
    assert chunking.split_text("abcdefgh", 3, 0, 0) == ["abc", "def", "gh"]
    assert chunking.split_text("aaaa bbbb c", 5, 0, 3) == ["aaaa ", "bbbb "]  # a last piece that is too short is lost
    assert chunking.split_text("aaaa bbbb cccc", 7, 2, 0) == ["aaaa ", "a bbbb ", "b cccc"]
    assert chunking.split_text("aaaaaaa bbbbbbb", 8, 3, 0) == ["aaaaaaa ", "bbbbbbb"]  # no overlap where it would not fit


def blocks_of(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id long, block_seq int, block_id string, block_type string, text string, parent_block_id string, ord int")


def test_chunk_documents(spark):
    blocks = blocks_of(
        spark, ("s1", "section", "Head", None, 1), ("p1", "paragraph", "one", "s1", 1), ("l1", "list_item", "", "s1", 2), ("n1", "note", "deep", "l1", 3),
        ("s2", "section", "Empty", "s1", 2), ("s3", "section", "Two", "s1", 3), ("p2", "paragraph", "x" * 40, "s3", 1), ("p3", "paragraph", "lost", "gone", 1),
    )
    rows = chunking.chunk_documents(blocks, child_max=30, overlap=0, least=0).orderBy("ord").collect()
    assert [(r["chunk_id"], r["text"], r["parent_chunk_id"], r["split_index"]) for r in rows] == [
        ("parent_s1", "Head\n\none\n\ndeep", None, 0), ("parent_s3", "Two\n\n" + "x" * 40, None, 0), ("child_p1", "one", "parent_s1", 0),
        ("child_n1", "deep", "parent_s1", 0), ("child_p2_part_1", "x" * 30, "parent_s3", 1), ("child_p2_part_2", "x" * 10, "parent_s3", 2), ("child_p3", "lost", None, 0),
    ]
    assert {(r["parent_id"], r["leaf_id"]) for r in chunking.descendant_leaves(blocks).collect()} == {("s1", "p1"), ("s1", "n1"), ("s1", "p2"), ("s3", "p2")}


def test_synthetic_parent(spark):
    blocks = blocks_of(spark, ("p1", "paragraph", "one", None, 1), ("p2", "paragraph", "two", None, 2))
    rows = chunking.chunk_documents(blocks).orderBy("ord").collect()
    assert [(r["chunk_id"], r["text"], r["parent_chunk_id"]) for r in rows] == [
        ("parent_doc_synthetic", "one\n\ntwo", None), ("child_p1", "one", "parent_doc_synthetic"), ("child_p2", "two", "parent_doc_synthetic"),
    ]
    raw = spark.createDataFrame([(1, "r" * 50 + " ")], "doc_id long, raw_text string")
    assert chunking.chunk_documents(blocks, raw, parent_max=20).filter("role = 'parent'").first()["text"] == "r" * 13 + "\n\n[...]"


# -- files, sets, settings


def test_walk(tmp_path):
    for name, text in SAMPLES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    names = [p.name for p in files.walk(tmp_path)[0]]
    assert names == ["a.md", "b.txt", "c.html", "d.json", "e.csv", "f.yaml", "g.py", "h.json"]
    assert [len(files.walk(tmp_path, recursive=False)[0]), *files.walk(tmp_path, max_files=2)[1:]] == [6, True]
    assert files.decode("é".encode("latin-1"), "latin-1") == ("é", "latin-1") and files.decode("é".encode())[0] == "é"


def test_qrels_and_subset(spark, tmp_path):
    item = {"id": "1", "query": "q", "relevant": [{"text_contains": "x"}], "expect_empty": True}
    for payload in ([item], {"queries": [item, {"id": 2, "query": "r"}]}):
        (tmp_path / "q.json").write_text(json.dumps(payload))
        rows = corpus.load_qrels(spark, str(tmp_path / "q.json")).orderBy("id").collect()
        assert rows[0]["relevant"][0]["text_contains"] == "x" and rows[0]["expect_empty"] is True and len(rows) == len(payload if isinstance(payload, list) else payload["queries"])
    docs = spark.createDataFrame([(i, "" if i == 2 else "t") for i in range(6)], "doc_id long, text string")
    judged = spark.createDataFrame([("a", 4, 1), ("b", 2, 1), ("c", 5, 0)], "query_id string, doc_id long, relevance int")
    rows, kept = corpus.corpus_subset(docs, judged, 3)
    assert {(r["kind"], r["doc_id"]) for r in rows.collect()} == {("needed", 4), ("filler", 0)}
    assert [r["query_id"] for r in kept.collect()] == ["a"]


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "s.yaml").write_text("retrieval:\n  top_k: 7\n  unknown: 1\nrerank_enabled: true\n")
    monkeypatch.setenv("SILTSTONE_RRF_K", "10")
    monkeypatch.setenv("SILTSTONE_INDEX_ROOTS", "/a:/b")
    found = load_settings(tmp_path / "s.yaml")
    assert (found.top_k, found.rrf_k, found.rerank_enabled, found.index_roots) == (7, 10, True, ("/a", "/b"))
    with pytest.raises(SettingsError):
        Settings(top_k=101)


# -- the engine


class Other(Provider):
    model = "other"


def test_engine(spark, tmp_path):
    folder = tmp_path / "files"
    for name, text in SAMPLES.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    engine = Engine(spark, scratch_path(spark, "index"))
    summary, results = engine.index(folder)
    assert (summary["new"], summary["failed"], summary["files"], summary["truncated"]) == (7, 1, 8, False)
    assert "invalid JSON" in results.filter("status = 'failed'").first()["error"]
    assert engine.index(folder)[0]["skipped"] == 7 and engine.version() == 1
    (folder / "b.txt").write_text("Entirely different paragraph about turbines.\n")
    assert engine.index(folder)[0]["changed"] == 1 and engine.version() == 2
    assert engine.table("documents").count() == 7
    hits = engine.retrieve(["turbines", "Alice admin"], mode="bm25").filter("rank = 1").orderBy("query_id").collect()
    assert "turbines" in hits[0]["text"] and "turbines" in hits[0]["parent_text"] and "Alice" in hits[1]["text"]
    packed = engine.context(["turbines", "zzzz"], mode="bm25").orderBy("query_id").collect()
    assert packed[0]["context"].startswith("[1] (") and packed[0]["label"] in ("high", "low") and packed[1]["label"] == "empty"
    assert engine.retrieve(["turbines"], mode="hybrid").count() == 5 and engine.retrieve(["turbines"], mode="hybrid", rerank=True).first()["score"] == 1.0
    with pytest.raises(ModelMismatch):
        Engine(spark, engine.folder.root, provider=Other()).retrieve(["x"], mode="vector")
    assert engine.retrieve(["turbines"], mode="bm25", collection="none").count() == 0
    qrels = [{"id": "1", "query": "turbines", "relevant": [{"text_contains": "TURBINES"}]}, {"id": "2", "query": "Alice", "relevant": [{"source_contains": "e.csv"}]}, {"id": "3", "query": "zz", "relevant": [], "expect_empty": True}]
    (tmp_path / "q.json").write_text(json.dumps(qrels))
    metrics, means = engine.evaluate(load_qrels(spark, str(tmp_path / "q.json")))
    assert {r["mode"]: r["hit_at_k"] for r in means.collect()}["bm25"] == 1.0
    assert engine.report(metrics, tmp_path / "r.json")["modes"]["bm25"]["mrr"] == 1.0 and (tmp_path / "r.md").exists()
    assert answer(engine, "GET", "/v1/health", {})["status"] == "ok"
    assert answer(engine, "POST", "/v1/retrieve", {"query": "turbines", "mode": "bm25"})["hits"][0]["rank"] == 1
    for body in ({}, {"query": "x", "top_k": 1000}):
        with pytest.raises(Refused):
            answer(engine, "POST", "/v1/retrieve", body)
    gone = engine.table("documents").first()["doc_id"]
    engine.delete([gone])
    assert engine.table("documents").count() == 6 and engine.table("chunks").filter(F.col("doc_id") == gone).count() == 0


def test_service_guards(tmp_path):
    assert authorized({}, None) and authorized({"X-API-Key": "k"}, "k") and authorized({"Authorization": "Bearer k"}, "k") and not authorized({}, "k")
    assert allowed_path(str(tmp_path), (str(tmp_path),)) == tmp_path.resolve()
    with pytest.raises(Refused):
        allowed_path("/etc", (str(tmp_path),))


def test_leaves_of_a_deep_tree(spark):
    """130 levels, more than a recursive query walks by default."""
    rows = [(f"s{i}", "section", "", f"s{i - 1}" if i else None, 1) for i in range(130)] + [("p", "paragraph", "deep", "s129", 1)]
    found = chunking.descendant_leaves(blocks_of(spark, *rows)).collect()
    assert sorted((r["parent_id"], r["leaf_id"]) for r in found) == sorted((f"s{i}", "p") for i in range(130))
    with pytest.raises(ValueError):
        chunking.descendant_leaves(blocks_of(spark, ("a", "section", "", "b", 1), ("b", "section", "", "a", 1), ("p", "note", "x", "a", 1)))


def test_extracted_text_gives_blocks(spark):
    rows = spark.createDataFrame([(n, b"One.\n\nTwo.") for n in ("a.pdf", "b.docx", "c.pptx", "d.json", "e.txt", "f", "g.csv")], "path string, content binary")
    got = {r["path"]: r for r in files.parse(rows, extracted=True).collect()}
    assert all([b["text"] for b in got[n]["blocks"]] == ["", "One.", "Two."] for n in ("a.pdf", "b.docx", "c.pptx", "d.json", "e.txt", "f"))
    assert [n for n in sorted(got) if got[n]["error"]] == ["a.pdf", "b.docx", "c.pptx", "d.json", "f"] and got["g.csv"]["blocks"]
    assert all(not r["blocks"] for r in files.parse(rows).collect() if r["error"])


def test_script_symbols():
    source = """// head {
import x from "y";
export async function load(a, b = {c: 1}) { return `t${a} {`; }
class Greeter extends Base {
  count = 0;
  static async greet(name) { if (name) { return "}"; } }
}
const twice = (x) => x * 2;
items.map(v => { return /[{]/.test(v); });
"""
    parsed = code.parse_code(source, ".js")
    got = {(m["qualified_name"], m["symbol_kind"]): b for b in parsed.blocks if "qualified_name" in (m := json.loads(b["metadata"]))}
    assert set(got) == {
        ("load", "function_declaration"), ("Greeter", "class_declaration"), ("Greeter.greet", "method_definition"), ("twice", "arrow_function"), ("anonymous", "arrow_function"),
    }
    assert got["Greeter", "class_declaration"]["block_type"] == "code_container" and got["Greeter", "class_declaration"]["text"] == "class Greeter extends Base {"
    assert got["Greeter.greet", "method_definition"]["text"] == 'static async greet(name) { if (name) { return "}"; } }'
    assert got["twice", "arrow_function"]["text"] == "(x) => x * 2" and got["load", "function_declaration"]["location"]["start_line"] == 3
    assert "count = 0;" in [b["text"] for b in parsed.blocks if b["block_type"] == "code_block"]
    types = code.parse_code("interface Shape<T> { area(): number; }\ntype Id =\n  | string\n  | number;\nfunction f<T>(x: T): Promise<T> { return x; }\n", ".ts")
    assert [json.loads(b["metadata"])["symbol_name"] for b in types.blocks[1:]] == ["Shape", "Id", "f"]
    assert code.parse_code("x = 1;\n", ".js").blocks[1]["block_id"] == "win_0"
    for broken in ("function f(", "class A {", "}}}", "`", "type T =", "a =>", "/*", "=> {"):
        code.parse_code(broken, ".tsx")


def test_registry(spark):
    def shout(path, content):
        out = files.Parsed("shout", [])
        out.blocks.append({"block_seq": 0, "block_id": "b", "block_type": "paragraph", "text": content.decode().upper(), "parent_block_id": None, "ord": 0, "hierarchy_path": ["b"], "location": None, "metadata": "{}"})
        return out

    registry = files.Registry()
    registry.add(files.Custom("shout", (".txt", ".loud"), ("text/loud",), shout), prepend=True)
    with pytest.raises(ValueError):
        registry.add(files.Custom("shout", (), (), shout))
    rows = spark.createDataFrame([("a.txt", b"x", None), ("b.loud", b"y", None), ("c", b"z", "text/loud"), ("d.md", b"w", None), ("e", b"# t", "text/markdown"), ("f", b"", None)], "path string, content binary, mime_type string")
    got = {r["path"]: r for r in files.parse(rows, registry=registry).collect()}
    assert [got[n]["blocks"][0]["text"] for n in ("a.txt", "b.loud", "c", "d.md", "e")] == ["X", "Y", "Z", "w", "t"] and got["f"]["error"]
    last = files.Registry()
    last.add(files.Custom("shout", (".txt", ".loud"), (), shout))
    assert [r[0] for r in rows.select(last.route(F.col("path"))).take(2)] == ["text", "shout"]


def test_merged_metadata(spark):
    rows = spark.createDataFrame([('{"title": "T", "n": 1}', '{"external_id": "7", "n": {"a": [2]}}'), ('{"a": 1}', None), (None, '{"b": 2}'), ("broken", '{"b": 2}')], "one string, two string")
    found = [r[0] for r in rows.select(incremental.merged_json("one", "two")).collect()]
    assert [json.loads(t) for t in found] == [{"title": "T", "external_id": "7", "n": {"a": [2]}}, {"a": 1}, {"b": 2}, {"b": 2}]


def test_providers_without_their_packages(spark, monkeypatch):
    for name in ("local", "openai"):
        monkeypatch.delenv("OPENAI_API_KEY", raising=False)
        with pytest.raises(SettingsError):
            providers.PROVIDERS[name](8)
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    remote = providers.RemoteProvider(4)
    assert remote.request(["a"])["dimensions"] == 4 and "dimensions" not in providers.RemoteProvider(4, "text-embedding-ada-002").request(["a"])
    rows = spark.createDataFrame([("ab",), (None,), ("c",)], "t string")
    length = providers._vectors(lambda: lambda texts: [[len(t), 1.0] for t in texts], 2)
    assert [r[0] for r in rows.select(length("t")).collect()] == [[2.0, 1.0], None, [1.0, 1.0]]
    with pytest.raises(Exception, match="3 are set"):
        rows.select(providers._vectors(lambda: lambda texts: [[0.0, 1.0]] * len(texts), 3)("t")).collect()
    pairs = spark.createDataFrame([("a", "aa"), ("b", None)], "q string, p string")
    scorer = providers.CrossEncoder("m", lambda: lambda both: [float(len(p)) for _, p in both])
    assert [r[0] for r in pairs.select(scorer.expression("q", "p")).collect()] == [2.0, 0.0]


def test_report_page():
    mode = {"hit_at_k": 0.8333, "ndcg_at_k": 0.675, "recall_at_k": 0.814, "mrr": 0.64, "confidence_intervals": {"hit_at_k": {"low": 0.79, "high": 0.87}}, "latency_ms": {"p50_ms": 41.2, "p95_ms": 88.9}}
    payload = {
        "suite": "s", "modes": {"bm25": mode}, "comparison": {"hybrid_minus_bm25_hit": -0.02}, "dataset": {"dataset_id": "d/test", "fingerprint": "f0", "subset": False},
        "run": {"environment": {"git_commit": "abc1234", "packages": {"numpy": "1"}}, "retrieval": {"embedding_model": "all-x"}, "index_seconds": 1.5},
    }
    page = report.report_markdown(payload)
    for part in ("0.833 [0.790, 0.870]", "| 41.2 | 88.9 |", "per document", "bootstrap", "abc1234", "all-x", "d/test (full)", "-0.020", "numpy: 1"):
        assert part in page
    payload["dataset"]["subset"] = True
    assert "(subset)" in report.report_markdown(payload)
    assert "| bm25 | 1.000 |" in report.report_markdown({"modes": {"bm25": {"hit_at_k": 1.0}}})


def test_engine_adds_segments(spark, tmp_path, monkeypatch):
    """A change writes its own documents only; merging changes no result."""
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(4):
        (folder / f"f{i}.txt").write_text(f"Document number{i} about shared words.\n")
    engine = Engine(spark, scratch_path(spark, "index"))
    engine.index(folder)
    (folder / "f1.txt").write_text("Replaced: turbines and shared words.\n")
    extra = spark.createDataFrame([(str(folder / "f1.txt"), "x1")], "path string, external_id string")
    engine.index(folder, extra=extra)
    assert engine.segments() == [1, 2]
    own = spark.read.parquet(f"{engine.folder.root}/data/2/documents")
    assert own.count() == 1 and json.loads(own.first()["extra_json"])["external_id"] == "x1"

    def results():
        hits = engine.retrieve(["turbines", "number1", "shared words"], mode="bm25", top_k=9)
        return sorted(tuple(r) for r in hits.select("query_id", "rank", "text", "score", "parent_text", "source_path").collect())

    before = results()
    assert not any("number1" in r[2] for r in before) and sum(r[0] == "q000000" for r in before) == 1
    engine.merge()
    assert engine.segments() == [3] and results() == before and engine.table("documents").count() == 4
    path = str(folder / "f1.txt")
    found = engine.get_document(path)
    text = engine.get_document_text(found["doc_id"])
    chunk = engine.table("chunks").filter((F.col("doc_id") == found["doc_id"]) & (F.col("role") == "child")).first()
    assert "turbines" in text and engine.get_document("no") is None and engine.get_document_text("no") is None
    assert engine.get_chunk(found["doc_id"], chunk["chunk_id"])["text"] in text and engine.get_parent(found["doc_id"], chunk["chunk_id"])["role"] == "parent"
    engine.delete([found["doc_id"]])
    assert engine.table("documents").count() == 3 and not any("turbines" in r[2] for r in results())
    monkeypatch.setattr("siltstone.engine.SEGMENTS", 1)
    (folder / "f2.txt").write_text("Changed again.\n")
    engine.index(folder)
    assert len(engine.segments()) == 1
    qrels = spark.createDataFrame([("1", "changed again", False, [(None, "changed", None)])], f"id string, query string, expect_empty boolean, relevant array<{corpus.RULE}>")
    made = engine.suite(folder, qrels, tmp_path / "out" / "r.json")
    assert made["modes"]["bm25"]["hit_at_k"] == 1.0 and made["run"]["index_seconds"] > 0 and "p50 ms" in (tmp_path / "out" / "r.md").read_text()


def test_pdf_elements_from_a_source(spark, monkeypatch):
    registry = files.Registry()
    registry.add(pdf.pdf_parser(lambda path, content: [{"type": "Title", "text": content.decode(), "metadata": {"page_number": 2}}], strategy="auto"), prepend=True)
    row = files.parse(spark.createDataFrame([("a.pdf", b"Report")], "path string, content binary"), registry=registry).first()
    assert [b["block_id"] for b in row["blocks"]] == ["page_2", "sec_1"] and json.loads(row["extra_json"]) == {"strategy": "auto", "element_count": 1, "block_count": 2}
    monkeypatch.delenv("PDF_API_KEY", raising=False)
    with pytest.raises(SettingsError):
        pdf.remote_elements("http://127.0.0.1:9")
    monkeypatch.setenv("PDF_API_KEY", "k")
    with pytest.raises(SettingsError):
        pdf.remote_elements("http://127.0.0.1:9", "best")
    with pytest.raises(ValueError, match="service failed"):
        pdf.remote_elements("http://127.0.0.1:9", timeout=1)("a.pdf", b"x")


def test_vector_bytes(spark):
    rows = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<double>").select(vectors.pack_bytes(F.col("v")).alias("b"))
    assert [None if r["b"] is None else bytes(r["b"]).hex() for r in rows.collect()] == ["0000c03f000000c0", "", None]
    assert [r[0] for r in rows.select(vectors.unpack_bytes(F.col("b"))).collect()] == [[1.5, -2.0], [], None]
    with pytest.raises(Exception, match="multiple of four"):
        spark.createDataFrame([(b"abc",)], "b binary").select(vectors.unpack_bytes(F.col("b"))).collect()


def test_judged_corpus(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d/1", "title": "T", "text": "one"}\n{"_id": "d2", "title": "", "text": "two"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "a"}\n{"_id": "q2", "text": "b"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td2\t1\nq1\td/1\t1\nq2\td2\t0\n")
    documents, queries, qrels = corpus.load_corpus(spark, str(tmp_path))
    assert {tuple(r) for r in documents.collect()} == {("d/1", "T\n\none"), ("d2", "two")} and qrels.count() == 3
    row = corpus.judged_queries(queries, qrels).collect()
    assert [(r["id"], [x["external_id"] for x in r["relevant"]]) for r in row] == [("q1", ["d/1", "d2"])]
    assert corpus.file_name("d/1") == "d_1.txt"


def test_service_and_client(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Wind moves ships.\n")
    engine = Engine(spark, scratch_path(spark, "index"))
    server = service.ThreadingHTTPServer(("127.0.0.1", 0), service.handler(engine, "k"))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        asked = client.Client(f"http://127.0.0.1:{server.server_port}", "k")
        assert asked.health()["status"] == "ok"
        assert asked.index(str(tmp_path), recursive=False)["new"] == 1
        found = asked.retrieve("wind", mode="bm25", top_k=1)
        assert found["mode"] == "bm25" and "Wind" in found["hits"][0]["text"] and found["reranked"] is False
        assert asked.context("wind ships", mode="bm25")["context"].startswith("[1]")
        for body, status in (({"query": " "}, 422), ({"query": "x", "top_k": 0}, 422), ({"query": "x", "top_k": "3"}, 422), ({"query": "x", "rerank": 1}, 422), ({"query": "x", "mode": "best"}, 422), ({"query": "x", "provider": "none"}, 422), ({"query": "x", "provider": "local"}, 400)):
            with pytest.raises(client.ServiceError) as error:
                asked._call("/v1/retrieve", body)
            assert error.value.status == status
        with pytest.raises(client.ServiceError) as error:
            client.Client(asked.url).retrieve("x")
        assert error.value.status == 401
    finally:
        server.shutdown()


def test_smoke(spark, capsys):
    assert command.smoke(spark) == 0 and json.loads(capsys.readouterr().out)["ok"]


def test_scratch_is_refused_without_a_shared_folder():
    class Master:
        master, _jsc = "spark://host:7077", None

    class Unset:
        conf = {}
        sparkContext = Master()

    Master._jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()
    with pytest.raises(session.SharedFolderMissing):
        session.scratch_root(Unset())
