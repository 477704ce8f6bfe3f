import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gazeframe.functions import text
from gazeframe.functions.hashing import md5_uniform
from gazeframe.operators import scoring

GOOD = '{"label": "mix", "confidence": 0.5, "reasoning": "r"}'
CASES = [
    (GOOD, ("mix", 0.5, "ok")),
    (f"```json\n{GOOD}\n```", ("mix", 0.5, "ok")),
    (f"Well: {GOOD} bye", ("mix", 0.5, "ok")),
    (GOOD[:-1], ("mix", 0.5, "ok")),
    ('{"label": "Focused ", "confidence": 1}', ("focused", 1.0, "ok")),
    ('{"label": "focused attention", "confidence": 0.2}', ("focused", 0.2, "invalid_label")),
    ('{"label": "banana", "confidence": 0.2}', ("mix", 0.2, "invalid_label")),
    ("I don't know", (None, None, "no_json")),
    ('{"label": "mix", "confidence": 1.7}', ("mix", 1.0, "ok")),
    ('{"label": "mix", "confidence": null}', (None, None, "invalid_confidence")),
    ('{"label": "mix", "label": "others", "confidence": 0.1}', ("others", 0.1, "ok")),
    ('["mix"]', (None, None, "no_json")),
    ('{"label": "mix", "confidence": 0.9, "reasoning": "first line\nsecond line"}', (None, None, "no_json")),
    ('{"label": "mix", "confidence": 0.9, "reasoning": "a\ttab"}', (None, None, "no_json")),
    ('{"label": "mix", "confidence": 0.2, "confidence": 0.3}', ("mix", 0.3, "ok")),
    ('{"label": "banana", "label": "others", "confidence": 0.1}', ("others", 0.1, "invalid_label")),
    ('{"label": "mix", "confidence": true}', ("mix", 1.0, "ok")),
    ('{"label": "mix", "confidence": " 7e-1 "}', ("mix", 0.7, "ok")),
    ('{"label": "mix", "confidence": "high"}', (None, None, "invalid_confidence")),
    ('{"label": "mix", "confidence": "0.5d"}', (None, None, "invalid_confidence")),
    ('{"label": "mix", "confidence": [1]}', (None, None, "invalid_confidence")),
    ('{"label": "mix", "confidence": NaN}', (None, None, "no_json")),
    ('{"label": ["focused"], "confidence": 0.5}', ("focused", 0.5, "invalid_label")),
    ('{"confidence": 0.5}', ("mix", 0.5, "invalid_label")),
    ('{"label": "mix"}', ("mix", 0.0, "ok")),
    ('{"a": 1}], [{"label": "mix"}', (None, None, "no_json")),
    ("{'label': 'mix'}", (None, None, "no_json")),
    ("", (None, None, "no_json")),
    (None, (None, None, "no_json")),
]


def test_parser(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, raw string")
    got = df.orderBy("i").select(text.parse_generation(F.col("raw")).alias("p")).select("p.*").collect()
    for (raw, want), r in zip(CASES, got, strict=True):
        assert (r["label"], r["confidence"], r["status"]) == want, raw


def twin(raw, allowed, default, rescue, quotes, fold):
    """The parser in Python, for comparison: (label, confidence, status)."""
    t = raw.strip()
    candidates = [t, *[x.strip() for x in re.findall(r"```(?:json)?\s*([\s\S]*?)\s*```", t) if x.strip()], *[x.strip() for x in re.findall(r"(\{[\s\S]*\})", t)]]
    for x in [*candidates, t[t.find("{") :].strip()] if "{" in t else candidates:
        open_ = x.count("{") - x.count("}")
        if x and not x.endswith("}") and open_ > 0:
            x += ('"' if quotes and '"reasoning"' in x else "") + "}" * open_
        try:
            read = json.loads(x, parse_constant=int)  # int("NaN") fails
        except (ValueError, RecursionError):
            continue
        if not isinstance(read, dict):
            break
        try:
            number = float(read.get("confidence", 0.0))
        except (TypeError, ValueError):
            return None, None, "invalid_confidence"
        seen = (lambda c: c.strip().lower()) if fold else str.strip
        label = seen(str(read.get("label", default)))
        if label not in allowed:
            label = next((a for a in allowed if rescue and (a in label or label in a)), default)
        shown = re.search(r'"label"\s*:\s*"([^"]*)"', t)
        return label, max(0.0, min(1.0, number)), "ok" if shown and seen(shown.group(1)) in allowed else "invalid_label"
    return None, None, "no_json"


SHAPES = [
    *[c for c, _ in CASES if c],
    'Sure: {"label": "rather focused", "confidence": 1e-1, "reasoning": null} ok',
    '```{"label":"mix"}``` and ```json {"label":"others","confidence":0.5}```',
    '{"label":"mix","confidence":"1_0"} ',
    '{"label":"inside_visible","confidence":"nan","reasoning":"a {b} c"}',
]
BITS = ['"', "{", "}", "\n", "\t", ",", ":", "[", "]", "\\", "true", "null", "0", ".", "-", "e", "NaN", " ", "label", '"label": "mix"', "```", "é", "\x1c", "_", "\\n", "\\u00e9", "inf"]


def test_parsers_against_a_twin_on_mutated_texts(spark):
    rng = random.Random(7)
    texts = list(SHAPES)
    while len(texts) < 20_000:
        x = rng.choice(SHAPES)
        for _ in range(rng.randrange(1, 5)):
            i, r = rng.randrange(len(x) + 1), rng.random()
            x = x[:i] + rng.choice(BITS) + x[i:] if r < 0.4 else x[:i] + x[i + rng.randrange(1, 4) :] if r < 0.7 else x[:i] if r < 0.85 else x[:i] + rng.choice(SHAPES) + x[i:]
        texts.append(x)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").repartition(4)
    wanted = ("label", "confidence", "status")
    got = df.select("i", text.parse_generation(F.col("raw")).alias("p"), text.parse_legacy(F.col("raw")).alias("q")).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["i"]]
        assert tuple(r["p"][w] for w in wanted) == twin(t, text.LABELS, "mix", True, False, True), t
        assert tuple(r["q"][w] for w in wanted) == twin(t, text.LEGACY_LABELS, "unsure", False, True, False), t


def test_legacy_parser(spark):
    cases = [('{"label": "outside", "confidence": 0.4, "reasoning": "cut o', ("outside", 0.4)), ('{"label": "Outside", "confidence": 1}', ("unsure", 1.0)), ("nothing", (None, None))]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, raw string")
    got = df.orderBy("i").select(text.parse_legacy(F.col("raw")).alias("p")).select("p.label", "p.confidence").collect()
    assert [tuple(r) for r in got] == [w for _, w in cases]


@pytest.fixture(scope="module")
def payload(spark):
    values = {c: 0.5 for c in text.RATIOS} | {c: 40 for c in text.COUNTS} | {"max_visible_streak": 30, "mean_gaze_motion": 150.0, "mean_head_area": 10.0, "mean_head_motion": 1.0, "dominant_gaze_class": "inside_visible"}
    return spark.createDataFrame([("a", *values.values())], ["child_id", *values])


def test_conditions(payload):
    got = {r["condition"]: r["prompt"] for r in text.conditions(payload).collect()}
    body = {c: json.loads(p.split("Features:\n")[1]) for c, p in got.items()}
    assert list(got) == ["C0", "C1", "C2", "C3", "C4"] and list(body["C0"]) == sorted(text.PAYLOAD)
    assert got["C1"].replace(text.GUIDANCE, "", 1) == got["C0"]
    assert (body["C2"]["visible_ratio"], body["C2"]["max_visible_streak"], body["C2"]["mean_gaze_motion"]) == ("medium", "high", "medium")
    assert "dominant_gaze_class" not in body["C3"] and len(body["C3"]) == len(body["C0"]) - 1
    assert all(abs(body["C4"][c] / body["C0"][c] - 1) <= 0.0500001 for c in text.RATIOS) and isinstance(body["C4"]["observed_frames"], int)


def test_no_anchor_fails(spark):
    with pytest.raises(Exception, match="no anchor"):
        spark.createDataFrame([("x",)], "t string").select(text.insert_before(F.col("t"), F.lit("y"))).collect()


def test_premises(payload):
    r = payload.select(*[c.alias(k) for k, c in text.premises().items()]).first()
    assert r["P1"].endswith("mean_gaze_motion=150.00, attention_stability_score=0.500, max_visible_streak=30.")
    assert "visible in 50% of the frames" in r["P2"] and "lasts 30 of 40 frames" in r["P2"]


def test_fewshot(spark):
    items = spark.createDataFrame([(i, i % 4, text.LABELS[i % 3]) for i in range(60)], "item_id long, cluster int, label string")
    ex = text.fewshot_examples(items, 1)
    got = ex.join(items.select("item_id", "cluster"), "item_id").join(items.select(F.col("item_id").alias("example_id"), F.col("cluster").alias("ec")), "example_id").collect()
    assert len(got) == 180 and all(r["cluster"] != r["ec"] for r in got)
    prompts = items.select("item_id", text.prompt(F.lit("{}")).alias("prompt"))
    made = text.fewshot_prompts(prompts, ex, items.select("item_id", F.lit("{}").alias("payload"))).first()["prompt"]
    assert made.count("Category: ") == 3 and made.index(text.FEWSHOT_OUTRO) < made.index(text.ANCHOR)


def test_fewshot_places_and_payloads(spark):
    """Items without a cluster or label are no examples, so each other item has all its examples; columns travel with them."""
    rows = [(i, None if i % 5 == 0 else i % 4, None if i % 7 == 0 else text.LABELS[i % 3], f"p{i}") for i in range(80)]
    items = spark.createDataFrame(rows, "item_id long, cluster int, label string, payload string")
    got = {}
    for r in text.fewshot_examples(items, 1, ["payload"]).collect():
        assert r["payload"] == f"p{r['example_id']}" and r["example_id"] % 5 and r["example_id"] % 7 and text.LABELS[r["example_id"] % 3] == r["label"]
        got.setdefault(r["item_id"], {})[r["place"]] = r["label"]
    assert set(got) == {i for i in range(80) if i % 5} and all(sorted(g) == [1, 2, 3] and sorted(g.values()) == sorted(text.LABELS) for g in got.values())
    made = text.fewshot_prompts(items.select("item_id", text.prompt(F.lit("{}")).alias("prompt")), text.fewshot_examples(items, 1, ["payload"]))
    assert made.count() == len(got) and made.first()["prompt"].count("Category: ") == 3


def test_votes_round_trip(spark):
    df = spark.createDataFrame([(1, 6, 0)], "f int, m int, o int")
    t = df.select(text.vote_text({"focused": F.col("f"), "mix": F.col("m"), "others": F.col("o")}).alias("t"))
    assert t.first()["t"] == "mix 6, focused 1"
    assert tuple(t.select(*text.vote_counts(F.col("t")).values()).first()) == (1, 6, 0)


def test_uniform_is_stable(spark):
    df = spark.range(1000)
    u = [r[0] for r in df.select(md5_uniform(1, "id")).collect()]
    assert u == [r[0] for r in df.repartition(7).orderBy("id").select(md5_uniform(1, "id")).collect()] and 0.45 < sum(u) / 1000 < 0.55


def test_scoring(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "item_id long, prompt string")

    def make():
        def scorer(texts):
            if "bad" in texts:
                raise ValueError("no")
            return [t.upper() for t in texts]

        return scorer

    got = {r["item_id"]: (r["raw"], r["error"]) for r in scoring.score(prompts.coalesce(1), make, ["item_id"]).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError"), 3: ("C", None)}
    assert [r[0] for r in scoring.pending(prompts, prompts.where("item_id < 3"), ["item_id"]).select("item_id").collect()] == [3]


def test_repeated_and_odd_texts_keep_their_rows(spark):
    odd = [None, '{"label": "mix", "confidence": 1' + "0" * 400 + "}", '{"label": "mix", "reasoning": "\\ud800"}', '{"label": "mix"}']
    df = spark.createDataFrame([(i, odd[i % 4]) for i in range(400)], "i int, raw string").repartition(3)
    parsed = df.select("i", text.parse_generation(F.col("raw")).alias("p"))
    assert "ArrowEvalPython" in parsed._jdf.queryExecution().executedPlan().toString()  # read by batches, a text once in each
    wanted = [(None, None, None, "no_json"), ("mix", 1.0, "", "ok"), ("mix", 0.0, "?", "ok"), ("mix", 0.0, "", "ok")]
    got = parsed.select("i", "p.label", "p.confidence", "p.reasoning", "p.status").collect()
    assert len(got) == 400 and all(tuple(r)[1:] == wanted[r["i"] % 4] for r in got)
