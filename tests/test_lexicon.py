"""Every branch of the decision table, on the climate lexicon and on a swapped one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from townhall_spark.functions import lexicon as lx
from townhall_spark.operators import extraction

pytest.importorskip("yaml")

CASES = {
    "We will build a seawall along the marina": ("adaptation", "sea_level_rise", 0.75),
    "The levee and the flood control works": ("adaptation", "flood", 0.9),
    "Wildfire season is near": ("adaptation", "wildfire", 0.75),
    "Cooling center hours": ("adaptation", "heat", 0.75),
    "Drought contingency for next year": ("adaptation", "drought", 0.75),
    "Climate resilience before the next hurricane": ("adaptation", "storm", 0.75),
    "A managed retreat programme": ("adaptation", "other", 0.75),
    "New electric buses for the city": ("mitigation", "none", 0.9),
    "Solar on the roof": ("mitigation", "none", 0.75),
    "Recycling and a levee": ("both", "flood", 0.9),
    "Climate change along the bike lane": ("both", "other", 0.6),
    "Climate change is a topic": ("unrelated", "none", 0.6),
    "I move to postpone": ("unrelated", "none", 0.5),
    "I move we fix the bike lane": ("unrelated", "none", 0.5),
    "A pedestrian bridge": ("unrelated", "none", 0.45),
    "Nothing here": ("unrelated", "none", 0.5),
    "i move we buy SOLAR panels": ("mitigation", "none", 0.75),
    "": ("unrelated", "none", 0.5),
    None: ("unrelated", "none", 0.5),
}


def test_decision_table(spark):
    lex = lx.load_lexicon()
    df = spark.createDataFrame([(t,) for t in CASES], "t string")
    rows = df.select("t", lx.classify(F.col("t"), lex).alias("c")).collect()
    assert {r.t: tuple(r.c) for r in rows} == CASES


def test_hits_overlap(spark):
    lex = lx.load_lexicon()
    df = spark.createDataFrame([("two electric buses",)], "t string")
    hits = df.select(lx.term_hits(F.upper("t"), lex.mitigation_strong).alias("h")).first().h
    assert hits == ["electric bus", "electric buses"]


def test_lexicon_shape():
    lex = lx.load_lexicon()
    assert [len(x) for x in (lex.adaptation_strong, lex.mitigation_strong, lex.climate_generic,
                             lex.weak_context, lex.procedural)] == [22, 28, 6, 7, 13]
    assert [h for h, _ in lex.hazards] == ["sea_level_rise", "flood", "wildfire", "heat",
                                           "drought", "storm"]
    assert sum(len(w) for _, w in lex.hazards) == 20


def test_extract_actions(spark):
    text = ("The council will raise the levee this year. Short solar. I move to adjourn this "
            "long meeting.\nSolar panels will be put on the library roof " + "x" * 600)
    rows = spark.createDataFrame([("a", text), ("b", None), ("c", "")],
                                 "canonical_id string, transcript string")
    out = extraction.extract_actions(rows, lx.load_lexicon()).orderBy("action_category").collect()
    assert [(r.canonical_id, r.action_category, r.hazard_type, len(r.action_text),
             r.model_version) for r in out] == [
        ("a", "adaptation", "flood", 43, "lexicon:climate-v1"),
        ("a", "mitigation", "none", 500, "lexicon:climate-v1")]
    assert all(r.extracted_at is not None for r in out)


def test_topic_swap_and_empty_lists(spark):
    housing = lx.Lexicon.from_mapping({
        "topic": "housing", "adaptation_strong": ["rent control"], "mitigation_strong": [],
        "climate_generic": [], "weak_context": [], "procedural": ["it's moved"],
        "hazards": {"eviction": ["evict"]}})
    df = spark.createDataFrame([("Rent control stops evictions",), ("it's moved",)], "t string")
    rows = df.select(lx.classify(F.col("t"), housing).alias("c")).collect()
    assert [tuple(r.c) for r in rows] == [("adaptation", "eviction", 0.75),
                                          ("unrelated", "none", 0.5)]


def test_prompts(spark):
    rows = spark.createDataFrame([("a", "z" * 7000), ("b", None)],
                                 "canonical_id string, transcript string")
    out = extraction.prompt_table(rows, "PROMPT").orderBy("canonical_id", "window_seq").collect()
    assert [(r.canonical_id, r.window_seq, r.prompt) for r in out] == [
        ("a", 0, "PROMPT\n\n## Transcript excerpt\n\n" + "z" * 6000 + "\n"),
        ("a", 1, "PROMPT\n\n## Transcript excerpt\n\n" + "z" * 1200 + "\n")]
    label = rows.select(extraction.label_prompt(F.substring("transcript", 1, 6000)).alias("p"))
    assert label.first().p.endswith("z" * 6000)
    with pytest.raises(Exception, match="more than 6000 characters"):
        rows.select(extraction.label_prompt(F.col("transcript")).alias("p")).collect()
    windows = extraction.label_prompts(rows, ["canonical_id"], "transcript").orderBy("window_seq")
    assert [r.prompt.count("z") - extraction.LABEL_PROMPT.count("z") for r in windows.collect()] \
        == [6000, 1200]
    assert all(r.prompt.startswith(extraction.LABEL_PROMPT) for r in windows.collect())


def test_many_terms_in_one_pass_find_what_a_search_for_each_finds(spark, monkeypatch):
    """Terms that overlap, begin with one another, and hold what patterns take for signs."""
    rng = random.Random(4)
    letters = "ab é水.-'\\(|"
    for _ in range(4):
        words = list({"".join(rng.choices(letters, k=rng.randrange(1, 5))) for _ in range(70)})
        texts = ["".join(rng.choices(letters + "\n", k=rng.randrange(40))) for _ in range(150)]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        text = F.col("t")
        lex = lx.Lexicon(tuple(words[:25]), tuple(words[25:40]), tuple(words[40:]), (), (),
                         (("x", tuple(words[:2])), ("y", tuple(words[2:30])), ("z", tuple(words))))
        found = df.select("t", lx.term_hits(text, words).alias("hits"),
                          lx.hazard_tag(text, lex).alias("hazard"), lx.classify(text, lex).alias("c"))
        assert lx.SINGLE_PASS_TERMS < len(words)
        once = found.collect()
        assert all(r.hits == [w for w in words if w in r.t] for r in once)
        with monkeypatch.context() as each:
            each.setattr(lx, "SINGLE_PASS_TERMS", 1000)
            assert once == df.select(
                "t", lx.term_hits(text, words).alias("hits"),
                lx.hazard_tag(text, lex).alias("hazard"), lx.classify(text, lex).alias("c")).collect()


def test_a_long_lexicon_is_one_pattern(spark):
    words = [f"term{i}" for i in range(1000)]
    plan = spark.range(1).select(lx.term_hits(F.col("id").cast("string"), words).alias("h"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") == 1 and "Contains" not in text
    assert re.compile(lx.term_pattern(words).replace("(?=[t])", "")).match("term12").group() == "term12"
