"""Cleaning, post-processing, splitting, decisions, extraction and prompts."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from inkfold.functions import config
from inkfold.functions import text as T
from inkfold.operators import decisions, extraction, postprocess, prompts, scoring, similarity, splitting
from inkfold.sources import tables


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def test_words_and_white_space(spark):
    texts = ["", " a  b c　d\n", "naïve x² y_z", " "]
    assert column(spark, texts, T.word_count) == [len(t.split()) for t in texts]
    assert column(spark, texts, T.strip) == [t.strip() for t in texts]
    assert column(spark, ["a.  b!c? d", " x ", "...", "Mr. X. "], T.sentences) == [["a.", "b!c?", "d"], ["x"], ["..."], ["Mr.", "X."]]


def test_clean_text(spark):
    cases = {"a\nb": "a\n\nb", "!!!!!! .....": "!!! ...", "é 漢​": "é 漢", "a \t b  \r\n\r\n\r\nc\x07": "a b\n\nc", "x﻿­�": "x", "\n\n": "", "a\rb": "a\n\nb"}
    assert column(spark, list(cases), T.clean_text) == list(cases.values())


def test_post_processing(spark):
    fix = {
        postprocess.fix_punctuation: {"x;y;": "x. Y.", "a;;b": "a. B", "wait...": "wait.", "a — b": "a, b", "a -- b": "a, b", "x--y": "x--y", "1;2": "1.2", "a, , b": "a, b"},
        postprocess.fix_whitespace: {"a  b \n\n\n\nc\t": "a b\n\nc"},
        postprocess.fix_curly_quotes: {"“a” ‘b’": "\"a\" 'b'"},
        postprocess.fix_emojis: {"a 😀 b🚀": "a b", "a  b": "a b"},
        postprocess.fix_excessive_bold: {"**a** **b** **c**": "**a** **b** **c**", "**a** **b** **c** **d**": "a b c d"},
        postprocess.fix_inline_header_lists: {"* **H**: body": "* H body", "- **Head:** x\n- **B** y": "- Head x\n- B y"},
        postprocess.fix_title_case_headings: {"## The Big Title Case Here": "## The big title case here", "# API design For Fun": "# API design For Fun", "# The NASA Launch Window": "# The NASA launch window", "text # Not A Heading": "text # Not A Heading"},
    }
    for fn, cases in fix.items():
        assert column(spark, list(cases), fn) == list(cases.values()), fn.__name__
    df = spark.createDataFrame([("a; b “c”",), ("fine.",), (None,)], "text string")
    rows = postprocess.post_process(df).collect()
    assert rows[0]["fixed"] == 'a. B "c"' and len(rows[0]["changes"]) == 2 and rows[1]["changes"] == [] and rows[2]["fixed"] is None


def test_chunks(spark):
    text = "A b c.\n\nD e.\n\nF g h i j. K l m n o."
    df = spark.createDataFrame([(1, text), (2, ""), (3, "short"), (4, "x" * 30), (5, "aa bb cc dd ee ff")], "doc_id long, text string")
    rows = {r["doc_id"]: [tuple(c) for c in r["chunks"]] for r in splitting.chunks(df, 12, merge=True).collect()}
    assert rows[1] == [("A b c.\n\nD e.", 0), ("F g h i j.", 2), ("K l m n o.", 2)]
    assert rows[2] == [] and rows[3] == [("short", 0)] and [len(t) for t, _ in rows[4]] == [12, 12, 6] and rows[5] == [("aa bb cc dd", 0), ("ee ff", 0)]
    rows = {r["doc_id"]: [tuple(c) for c in r["chunks"]] for r in splitting.chunks(df, 12).collect()}
    assert rows[1] == [("A b c.", 0), ("D e.", 1), ("F g h i j.", 2), ("K l m n o.", 2)]


def test_chunks_keep_the_text(spark):
    text = "\n\n".join(" ".join(f"Word{i} and {j} more." for j in range(i % 5 + 1)) for i in range(20)) + "\n\n" + "z" * 100
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for merge in (False, True):
        chunks = splitting.chunks(df, 40, merge=merge).first()["chunks"]
        assert re.sub(r"\s", "", "".join(c["text"] for c in chunks)) == re.sub(r"\s", "", text)
        assert [c["para_idx"] for c in chunks] == sorted(c["para_idx"] for c in chunks)


def test_cjk_and_finer(spark):
    assert column(spark, ["你好。再见！A.B", "", "One. Two"], splitting.cjk_sentences) == [["你好。", "再见！", "A.", "B"], [""], ["One.", "Two"]]
    assert column(spark, ["A. B. C."], lambda c: splitting.split_finer(c, 0)) == [["A. B. C."]]
    assert column(spark, ["A. B. C."], lambda c: splitting.split_finer(c, 1)) == [["A. B.", "C."]]
    assert column(spark, ["A. B. C."], lambda c: splitting.split_finer(c, 2)) == [["A.", "B.", "C."]]


def test_segments(spark):
    def brute(sents, target):
        parts, cur, run = [], [], 0
        for i, s in enumerate(sents):
            n = len(s.split())
            if run + n > target and cur:
                parts.append(cur)
                cur, run = [], 0
            cur.append(i)
            run += n
        if parts and run < 0.4 * target:
            parts[-1] += cur
        else:
            parts.append(cur)
        return parts

    texts = [" ".join("w " * ((i * 7 + k) % 13 + 1) + f"s{i}." for i in range(30)) for k in range(5)] + ["One two.", "a " * 50 + "end. b."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for target in (10, 40, 10_000):
        rows = splitting.segments(df, target).orderBy("doc_id", "seg_idx").collect()
        for k, text in enumerate(texts):
            sents = re.split(r"(?<=[.])\s+", text)
            own = [r for r in rows if r["doc_id"] == k]
            want = brute(sents, target) if sum(len(s.split()) for s in sents) > target else [list(range(len(sents)))]
            assert [r["sentence_indices"] for r in own] == want
            for a, b in zip(own, own[1:]):
                assert a["context_after"] == " ".join(sents[i] for i in b["sentence_indices"][:2]) and b["context_before"] == " ".join(sents[i] for i in a["sentence_indices"][-2:])


def test_align(spark):
    got = column(spark, ["A. B. C. D.", "A.", "A. B. C."], lambda c: splitting.align(T.sentences(c), F.lit(3)))
    assert got == [["A.", "B.", "C. D."], ["A.", "", ""], ["A.", "B.", "C."]]


def test_actions_and_budgets(spark):
    cases = [(0.65, True, None, "rewritten"), (0.64, True, 0.85, "deleted"), (0.9, False, 0.84, "unfixed_risky"), (0.9, False, None, "unfixed_risky"), (0.9, True, 0.9, "rewritten")]
    df = spark.createDataFrame(cases, "s double, ok boolean, w double, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", decisions.sentence_action(F.col("s"), F.col("ok"), F.col("w")).alias("got")).collect())
    df = spark.createDataFrame([(100, None), (1500, 0.4)], "n int, s double")
    got = [[r["b"][t] for t in decisions.TECHNIQUE_ORDER] for r in df.select(decisions.technique_budget(F.col("n"), F.col("s")).alias("b")).collect()]
    assert got == [[1, 1, 1, 2, 2, 1], [3, 3, 2, 3, 3, 3]]


def test_best_candidates(spark):
    c = [(1, 0, "a", 0.4, 0.9, 10, 10), (1, 1, "b", 0.3, 0.4, 10, 10), (1, 2, "c", 0.4, 0.9, 10, 10), (2, 0, "d", 0.5, 0.1, 10, 10), (2, 1, "e", 0.4, 0.2, 10, 10), (3, 0, "f", 0.1, 0.9, 4, 10), (3, 1, "g", 0.1, 0.9, 50, 30)]
    df = spark.createDataFrame(c, "doc_id long, ord int, text string, ai_score double, sem double, words int, source_words int")
    src = spark.createDataFrame([(i, f"s{i}") for i in range(1, 5)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in decisions.best_candidates(df, src).collect()} == {1: "a", 2: "e", 3: "s3", 4: "s4"}


def test_marks(spark):
    df = spark.createDataFrame([("the cat sat on the mat", ["cat", "cat sat", "mat", "dog", ""])], "t string, n array<string>")
    assert [tuple(x) for x in df.select(decisions.mark_positions(F.col("t"), F.col("n")).alias("m")).first()["m"]] == [(4, 11), (19, 22)]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"rewrite": "It rained all day."}', "It rained all day."),
        ('so {x} then ```json\n{"rewrite": "It rained all day."}\n```', "It rained all day."),
        ('{"rewrite": "It "really" rained."}', 'It "really" rained.'),
        ('{"rewrite": "It rained all', "It rained all"),
        ("Rewritten: It rained all day.", "It rained all day."),
        ("{It rained all day.}", "It rained all day."),
        ("It rained all day.\n\nNote that I changed the verb.", "It rained all day."),
        ('{"other": 1}{"rewrite": "Wet \\u00e9t\\u00e9."}', "Wet été."),
        ('"It rained all day."', "It rained all day."),
        ("", "It has rained the whole day."),
    ],
)
def test_extraction(answer, want):
    source = "It has rained the whole day."
    assert extraction.clean(extraction.raw_rewrite(answer, source), source) == want


@pytest.mark.parametrize("source", ["", " \n ", '"', '""', "\\", "\"'tis so.", "a\rb and a long c\td and so on", "so it is'\""])
def test_extraction_of_odd_sources(source):
    """The forms of the query's answers, as its SQL has them; blank texts gave pieces of JSON, or the remark about them."""
    body = re.sub(r'[\n"\\]', " ", source)
    answers = ['{"rewrite": "' + body + '"}', '```json\n{"rewrite": "' + body + '"}\n```', '{"rewrite": "' + body, "Rewritten: " + body, "{" + body + "}", body + "\n\nNote that I changed it."]
    assert {extraction.clean(extraction.raw_rewrite(a, source), source) for a in answers} == {body.strip() or source.strip()}
    if not source.strip(' \n"'):
        assert extraction.clean(extraction.raw_rewrite('{"rewrite": "a "quoted" ' + body + '"}', source), source) == 'a "quoted"'


def test_length_guard():
    assert extraction.length_guard("a b c d e f g h", "x y") == "a b c d e"
    assert extraction.length_guard("word " * 100, "one two three four") == ("word " * 12)[:58]
    assert extraction.length_guard("", "src") == "src"
    text = "Short start here now. " + "y" * 500
    assert extraction.length_guard(text, "Some source of some words. It goes on a bit.").startswith("Short start here now. y")


def test_extraction_in_spark(spark):
    df = spark.createDataFrame([('{"rewrite": "Yes it is."}', "It is so."), (None, "x"), ("text", None)], "a string, s string")
    assert [r["x"] for r in df.select(extraction.extract_rewrite(F.col("a"), F.col("s")).alias("x")).collect()] == ["Yes it is.", None, "text"]


def test_rewriter_errors_are_values(spark):
    class Fake:
        def rewrite(self, prompt, temperature):
            if prompt == "fail":
                raise OSError("no network")
            return {"same": " the  source ", "empty": " "}.get(prompt, prompt + "!")

    df = spark.createDataFrame([(p, "the source", 0.7) for p in ("ok", "fail", "same", "empty")], "prompt string, source string, temperature double")
    got = {r["prompt"]: (r["rewrite"], r["error"]) for r in scoring.rewrite_rows(df, Fake).collect()}
    assert got["ok"] == ("ok!", None) and got["fail"] == (None, "no network") and got["same"][0] is None and got["empty"][0] is None


def test_detector_interface(spark):
    class Model:
        name = "length"

        def score_batch(self, texts):
            return [min(1.0, len(t) / 10) for t in texts]

    df = spark.createDataFrame([("abc",), (None,), ("a" * 50,)], "t string")
    assert [r["s"] for r in df.select(scoring.detector_column(Model, F.col("t")).alias("s")).collect()] == [0.3, None, 1.0]


def test_http_adapter():
    r = tables.HttpRewriter("http://localhost/x", "m", key="k", auth="x-api-key", kind="messages")
    assert r.auth_headers() == {"x-api-key": "k"} and r.payload("p", 0.5)["messages"][0]["content"] == "p"
    assert r.answer_text({"choices": [{"message": {"content": [{"text": "a"}, {"text": "b"}]}}]}) == "ab" and r.answer_text({"content": [{"type": "text", "text": "c"}]}) == "c"
    lines = [f"data: {json.dumps({'choices': [{'delta': {'content': x}}]})}" for x in "hey"]
    assert r.stream_text([*lines, "data: [DONE]", "data: no"]) == "hey" and r.stream_text(['{"choices": [{"message": {"content": "z"}}]}']) == "z"


def test_http_stream():
    """Server-sent events over a connection, after one answer of an overloaded server."""
    import http.server
    import threading

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(503 if len(asked) == 1 else 200)
            self.end_headers()
            if len(asked) > 1:
                for x in ("he", "llo"):
                    self.wfile.write(f"data: {json.dumps({'choices': [{'delta': {'content': x}}]})}\n\n".encode())
                self.wfile.write(b"data: [DONE]\n\n")

        def log_message(self, *_):
            pass

    with http.server.HTTPServer(("127.0.0.1", 0), Handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        try:
            got = tables.HttpRewriter(f"http://127.0.0.1:{server.server_port}/", "m", stream=True, timeout=10).rewrite("p", 0.1)
        finally:
            server.shutdown()
    assert got == "hello" and asked[1]["stream"] is True and len(asked) == 2


def test_detectors_are_told_apart_by_content(spark):
    def maker(k):
        class Model:
            name = "m"

            def score_batch(self, texts):
                return [k / 10 for _ in texts]

        return lambda: Model()

    df = spark.createDataFrame([("abc",)], "t string")
    assert [df.select(scoring.detector_column(maker(k), F.col("t")).alias("s")).first()["s"] for k in (1, 2, 1)] == [0.1, 0.2, 0.1]


def test_guard_length_as_an_expression(spark):
    texts = ["", " ", "a b", "One. Two! Three? " * 9, "x" * 300, "word " * 80, "no end here at all " * 20, "汉字。" * 90]
    rows = [(a, b) for a in [*texts, None] for b in [*texts, None]]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", extraction.guard_length(F.col("a"), F.col("b")).alias("x"))
    for r in df.collect():
        assert r["x"] == (None if r["a"] is None else extraction.length_guard(r["a"], r["b"] or "")), r


def test_similarity(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r["x"] for r in df.select(similarity.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == 0 and abs(got[1] - 1) < 1e-12 and got[2] is None
    left = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 0.0])], "d long, i int, embedding array<double>")
    right = spark.createDataFrame([(1, 5, [1.0, 0.1]), (1, 6, [2.0, 0.2]), (1, 7, [0.0, 3.0])], "d long, j int, embedding array<double>")
    got = {(r["d"], r["i"]): (r["best_idx"], round(r["similarity"], 3)) for r in similarity.nearest(left, right, ["d"], "i", "j").collect()}
    assert got == {(1, 0): (5, 0.995), (1, 1): (7, 1.0), (2, 0): (None, 1.0)}


def test_prompts(spark):
    df = spark.createDataFrame([("text here", 0.8)], "t string, s double")
    v = F.array(F.struct(F.lit("punct.semicolon").alias("rule_id"), F.lit("split it").alias("suggestion")))
    row = df.select(
        prompts.rewrite_prompt(F.col("t"), F.col("s"), F.lit("unknown"), F.lit(True)).alias("p3"), prompts.sentence_prompt(F.col("t"), v, F.lit(""), F.lit("after"), F.col("s")).alias("p4"),
        prompts.polish_prompt(F.col("t"), decisions.technique_budget(F.lit(100), F.col("s")), F.array(F.lit("human.no_question"), F.lit("other")), F.col("s"), F.lit("casual")).alias("p5"),
        prompts.formality_prompt(F.col("t"), F.lit("casual")).alias("p6"), prompts.formality_prompt(F.col("t"), F.lit("academic")).alias("p6a"),
        prompts.sentence_label(v, F.lit("medium"), F.lit("hot")).alias("label"), prompts.sentence_label(F.slice(v, 1, 0), F.lit("clean"), F.lit("low")).alias("plain"),
    ).first()
    assert "0.40" in row["p3"] and "text here" in row["p3"] and prompts.GUIDE["academic"] in row["p3"]
    assert "punct.semicolon: split it" in row["p4"] and "[before]" not in row["p4"] and "[after] after" in row["p4"]
    assert "understatement" in row["p5"] and "- other" in row["p5"] and "high (0.80)" in row["p5"]
    assert row["p6"] == "" and "text here" in row["p6a"] and row["label"] == "MEDIUM: punct.semicolon | AI-hot" and row["plain"] == "CLEAN"


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"rewrite_sem": 0.5}')
    assert config.load_config(str(p)).rewrite_sem == 0.5 and config.load_config(None) == config.DEFAULT
    p.write_text("{nonsense")
    assert config.load_config(str(p)) == config.DEFAULT
    assert config.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, " \n"), (3, None), (4, "x" * 50_001)], "doc_id long, text string")
    good, bad = tables.validate(df)
    assert [r["doc_id"] for r in good.collect()] == [1] and {r["doc_id"]: r["problem"] for r in bad.collect()} == {2: "blank", 3: "blank", 4: "too_long"}
    tables.write_results(df.withColumn("input_text", F.lit("long")), str(tmp_path / "out"))
    back = tables.load_documents(spark, str(tmp_path / "out"), "json", schema="doc_id long, text string, input_text string")
    assert back.where("input_text is not null").count() == 0 and back.count() == 4


def test_hard_cuts_without_python(spark):
    """The pattern cuts as the loop does; it runs in the JVM, as Python's batches grew with the texts."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab  é\n\t　😀.", k=rng.randint(0, 60))) for _ in range(300)] + [" " * 40, "x" * 50, " x" * 30, "word " * 30, "  " + "y" * 25 + "   "]
    for most in (1, 2, 7, 20):
        want = [splitting.cut_hard(t, most) if len(t) > most else [t] if t else [] for t in texts]
        assert column(spark, texts, lambda c, m=most: splitting.hard_split(c, m)) == want
    plan = spark.createDataFrame([("x" * 500,)], "text string").select(splitting.hard_split(F.col("text"), 120))
    assert "ArrowEvalPython" not in plan._jdf.queryExecution().toString()


def test_nearest_over_blocks(spark, monkeypatch):
    """Groups larger than a block, equal vectors, vectors of zeros, null groups and rows without a partner give what all pairs give."""
    rng = random.Random(4)
    vectors = [[float(rng.randint(-2, 2)) for _ in range(3)] for _ in range(80)]
    rows = [(i, rng.choice([None, "a", "b"]) if i < 78 else f"lone{i}", vectors[rng.randrange(80)]) for i in range(80)]
    df = spark.createDataFrame(rows, "i long, g string, embedding array<float>")
    monkeypatch.setattr(similarity, "BLOCK", 7)
    got = {r["i"]: (r["best_idx"], r["similarity"]) for r in similarity.nearest(df.where("i % 2 = 0"), df.where("i % 2 = 1"), ["g"], "i", "i").collect()}
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    for i, g, v in rows[::2]:
        pairs = [(dot(v, w) / (dot(v, v) * dot(w, w)) ** 0.5 if dot(v, v) * dot(w, w) else None, j) for j, h, w in rows[1::2] if h == g]
        top = max((s for s, _ in pairs if s is not None), default=None)
        near = [j for s, j in pairs if (s is None) == (top is None) and (top is None or s > top - 1e-12)]
        want = (min(near), top) if pairs else (None, 1.0)
        assert (got[i][0], got[i][1] if top is None else round(got[i][1], 9)) == (want[0], want[1] if top is None else round(want[1], 9)), i
