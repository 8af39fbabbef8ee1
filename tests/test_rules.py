"""Rules, their spans and grades on hand-made sentences."""

import re

import pytest
from pyspark.sql import functions as F

from inkfold.functions import text as T
from inkfold.functions.lexicon import ABSTRACT_NOUNS, PHRASES, RULES
from inkfold.operators import rules, severity
from inkfold.plans import analysis, planted

CASES = [
    ("punct.em_dash", "It came — and went – twice -- then.", 3),
    ("punct.em_dash", "A well-known state--of things", 0),
    ("punct.semicolon", "a; b; c", 2),
    ("punct.colon_overuse", "so: this: That: 5:30 x:y", 1),
    ("struct.not_x_but_y", "It is not a bug, but a feature", 1),
    ("struct.not_x_but_y", "They went rather than wait, not because of us", 2),
    ("struct.not_x_but_y", "It is not here", 0),
    ("struct.triple_parallel", "The old house, the green garden, and the blue river", 1),
    ("struct.triple_parallel", "One and two", 0),
    ("struct.abstract_noun_stack", "A framework for the governance of an ecosystem", 1),
    ("struct.abstract_noun_stack", "A framework and governance", 0),
    ("struct.tailing_negation", "It works, no setup needed.", 1),
    ("struct.tailing_negation", "It works, No setup needed.", 0),
    ("struct.tailing_negation", "It works, no one of us knows.", 0),
    ("vocab.high_risk_transition", "However, it rained; moreover it was cold, howeverest", 2),
    ("vocab.cliche_phrase", "We navigate the complexities of life", 2),
    ("vocab.ai_filler", "They delve into it, notably", 2),
    ("content.significance_inflation", "It was a pivotal role and a pivotal rolex", 2),
    ("content.promotional", "A vibrant, must-visit town, vibrantly", 2),
    ("content.superficial_ing", "It grew, highlighting a need, fostering trust, fosterings", 2),
    ("artifact.chatbot", "I hope this helps, i hope this helps", 1),
    ("artifact.knowledge_cutoff", "As of my last update", 1),
    ("style.copula_avoidance", "It serves as a hub and boasts a pool, boasts an inn", 2),
    ("style.generic_conclusion", "The future looks bright", 1),
    ("style.persuasive_trope", "The real question is who", 1),
    ("style.signposting", "Let's dive in", 1),
]


def test_counts_and_catalogue():
    assert len(RULES) == 24 and sum(map(len, PHRASES.values())) == 120 and len(ABSTRACT_NOUNS) == 40
    assert [r.order for r in RULES.values()] == list(range(1, 25))


def test_sentence_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r["doc_id"]: r["c"] for r in rules.analyze(df).groupBy("doc_id").agg(F.flatten(F.collect_list("violations"))["rule_id"].alias("c")).collect()}
    for i, (rule, text, n) in enumerate(CASES):
        assert got[i].count(rule) == n, (rule, text)


def test_spans_hold_the_match(spark):
    texts = [*planted.ALL, "naïve café; the “end”— yes 😀; x", "İstanbul; however, é--è -- ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = rules.analyze(df).select("text", F.explode("violations").alias("v")).select("text", "v.*").where("rule_id not like 'human%' and rule_id not like 'syntax%'").collect()
    assert len(rows) > 150
    for r in rows:
        piece = r["text"][r["span"]["start"] : r["span"]["end"]]
        phrases = PHRASES.get(r["rule_id"])
        if phrases:
            assert piece.lower() in phrases
        elif r["rule_id"] != "struct.abstract_noun_stack":
            assert piece and piece in r["context"]
        assert r["severity"] == RULES[r["rule_id"]].severity and r["suggestion"]


def test_order_of_violations(spark):
    text = "However, it serves as a hub; however — not because of us."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ids = [v["rule_id"] for v in rules.analyze(df).first()["violations"]]
    orders = [RULES[i].order for i in ids]
    assert orders == sorted(orders) and ids.count("vocab.high_risk_transition") == 2


LONG = "The committee wanted to read every one of the many pages before the meeting began again."


@pytest.mark.parametrize(
    ("text", "fires"),
    [
        (" ".join([LONG] * 3), {"syntax.uniform_rhythm", "human.no_colloquial", "human.no_short_sentence", "human.no_question"}),
        (" ".join([LONG] * 2) + " Well, no?", set()),
        ("The cup was broken. They were taken and are given. It is frozen?", {"syntax.passive_stack", "human.no_colloquial"}),
        ("Was it? It was opened. Just that.", set()),
        ("Short.", {"human.no_colloquial", "human.no_question"}),
    ],
)
def test_document_rules(spark, text, fires):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = rules.analyze(df).orderBy("idx").collect()
    assert {v["rule_id"] for v in rows[0]["violations"]} & set(rules.DOCUMENT_RULES) == fires
    assert not any(v["rule_id"] in rules.DOCUMENT_RULES for r in rows[1:] for v in r["violations"])


def test_awkward_documents(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "One.   Two!\n\nThree?"), (None, "x")], "doc_id long, text string")
    rows = rules.analyze(df).collect()
    assert sorted((str(r["doc_id"]), r["idx"], r["text"]) for r in rows) == [("4", 0, "One."), ("4", 1, "Two!"), ("4", 2, "Three?"), ("None", 0, "x")]


def test_grades(spark):
    levels = [[], ["low"], ["medium", "low"], ["high"], ["high", "high"], ["critical"], ["medium"] * 5]
    df = spark.createDataFrame([(i, [(s,) for s in x]) for i, x in enumerate(levels)], "i int, v array<struct<severity:string>>")
    got = [r["g"] for r in df.select("i", severity.rule_severity(F.col("v")).alias("g")).orderBy("i").collect()]
    assert got == ["clean", "low", "medium", "high", "critical", "critical", "medium"]


def test_fusion_bounds(spark):
    cases = [("clean", 1.5, True, "clean"), ("clean", 1.51, True, "medium"), ("medium", 1.0, True, "medium"), ("medium", 1.01, True, "high"), ("high", -1.0, True, "high"), ("high", -1.01, True, "medium"), ("critical", -9.0, True, "critical"), ("low", 9.0, True, "low"), ("clean", 9.0, False, "clean")]
    df = spark.createDataFrame(cases, "s string, z double, u boolean, want string")
    for r in df.select("*", severity.fuse(F.col("s"), F.col("z"), F.col("u")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_scores_and_heat(spark):
    scores = [0.9, 0.2, 0.7, 0.3, 0.8, 0.1, 0.6, 0.4]
    text = " ".join(f"Sentence number {i} is here." for i in range(10))
    df = spark.createDataFrame([(1, text), (2, "Alone.")], "doc_id long, text string")
    own = analysis.scored(df, score=F.element_at(F.array(*map(F.lit, scores)), F.pmod("idx", F.lit(8)) + 1))
    rows = {(r["doc_id"], r["idx"]): r for r in own.collect()}
    of = [rows[(1, i)] for i in range(10)]
    mean = sum(r["ai_score"] for r in of) / 10
    assert abs(of[0]["doc_mean"] - mean) < 1e-9 and of[0]["model_useful"]
    by_heat = sorted(of, key=lambda r: (-r["ai_score"], r["idx"]))
    assert [r["heat"] for r in by_heat] == ["hot"] * 2 + ["warm"] * 3 + ["low"] * 5
    alone = rows[(2, 0)]
    assert alone["doc_std"] == 0 and not alone["model_useful"] and alone["ai_z_score"] == 0


def test_results_dont_depend_on_partitions(spark):
    df = spark.createDataFrame(list(enumerate(planted.ALL * 2)), "doc_id long, text string")
    a = sorted(map(str, analysis.graded(df.repartition(1)).collect()))
    assert a == sorted(map(str, analysis.graded(df.repartition(7)).collect()))


def test_edges_of_words_are_those_of_sql(spark):
    """SQL's engine sees edges of words at ASCII letters only, so "Übeen taken" holds a passive, and "öhowever" a phrase."""
    import duckdb

    from inkfold.plans import sql

    texts = ["Übeen Übeen Übeen Übeen here. It is so.", "It was openedé. WAS TAKENé and is given. They were brokenß.", "éwas taken, ñis given, übeing seen. He ran.", "Öhowever, indeedé it seems. She sat.", "énot because of it. ratherß than. Unot, but no."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    src = "SELECT doc_id, text FROM documents"
    own = df.select("doc_id", rules.passive_window(T.sentences(F.col("text")), F.col("text")).alias("i")).where("i is not null")
    want = con.sql(f"WITH s AS ({sql.sentences(src)}) {sql.passive()}").fetchall()
    assert want and sorted(map(tuple, own.collect())) == sorted(want)
    for rule in ("vocab.high_risk_transition", "struct.not_x_but_y"):
        got = rules.analyze(df, rules=[rule]).select("doc_id", "idx", F.size("violations").alias("n")).where("n > 0")
        want = con.sql(sql.rule_counts(rule, src)).fetchall()
        assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_anchors_find_every_phrase():
    """One pass finds what each of some 190 passes over a text found, overlapping words too."""
    words = (*(p for ps in PHRASES.values() for p in ps), *ABSTRACT_NOUNS)
    own, pattern = T.anchors(words), re.compile(T.anchored(words))
    assert not [(a, b) for a in set(own.values()) for b in set(own.values()) if a != b and a.startswith(b)]
    for w in words:
        assert own[w] in w
        for text in (w, f"xx{w}yy", f"{w}{w}", f"{w[0]}{w}"):
            assert own[w] in {m[1] for m in pattern.finditer(text)}, w


@pytest.mark.parametrize("name", ["stubborn_sentences", "prompt_stage3"])
def test_sentences_are_analysed_once(spark, name, tmp_path):
    """These were joined with a second analysis of all documents."""
    from inkfold.plans import registry

    spark.createDataFrame([(i, f"However, it is so; they delve. Plain text {i}.") for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() and plan.count("Generate posexplode") <= 1
