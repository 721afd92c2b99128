import json

import numpy as np
import pytest

from semspark.llm import defects
from semspark.llm.defects import LabelModel, answer_facts, defect_posteriors, one_defect, read_answer, sql_is_cut

SQL = "SELECT a, b, SUM(c) AS \"量\" FROM t WHERE org_code = 'ORG_1' AND d BETWEEN 1 AND 2 GROUP BY a, b ORDER BY a DESC LIMIT 5"
SCHEMA = "call_id long, question string, response string, defect string, votes int, half int"


def test_every_cut_of_a_grouped_statement_is_seen():
    ends = {SQL[:i].strip() for i in range(10, len(SQL)) if not sql_is_cut(SQL[:i])}
    assert ends == {SQL[: SQL.index(x)].strip() for x in ("ORDER", "DESC", "LIMIT")}  # these might as well be whole


@pytest.mark.parametrize("sql", [SQL, "WITH x AS (SELECT a, COUNT(b) AS n FROM t GROUP BY a)\nSELECT * FROM x", "SELECT * FROM t", "SELECT COUNT(*) FROM t WHERE x IS NOT NULL", "select a from t where b = ?", "SELECT a, SUM(b) FROM t GROUP BY 1", "SELECT a, SUM(b) FROM t GROUP BY a, c", "SELECT a AS x, SUM(b) FROM t GROUP BY x", "SELECT a, SUM(b) FROM t GROUP BY ROLLUP(a)", "SELECT a, SUM(b) OVER (PARTITION BY a) FROM t", "SELECT t.a, SUM(t.b) FROM t GROUP BY a", "SELECT a FROM t WHERE is_active", "SELECT a FROM t WHERE b IS NOT TRUE", "SELECT 1", "SELECT a FROM t ORDER BY a NULLS LAST"])
def test_whole_statements_are_not_cut_(sql):
    assert not sql_is_cut(sql)


@pytest.mark.parametrize("sql", ["SELECT a, SUM(b) FROM t", "SELECT a, b, SUM(c) FROM t GROUP BY a", "SELECT a, b", "SELECT a FROM t WHERE b", "SELECT a FROM t WHERE b = 'x", "SELECT SUM(a", "SELECT a FROM t WHERE b IS NOT", "SELECT a FROM t GROUP BY a OR", "WITH x AS (SELECT a FROM t)"])
def test_cut_statements(sql):
    assert sql_is_cut(sql)


@pytest.mark.parametrize("sql", [SQL])
def test_whole_statements_are_not_cut(sql):
    assert not sql_is_cut(sql)


def pairs():
    q = "Show the sales of ORG_{} by country for February 2026."
    full = lambda s, e: json.dumps({"assumptions": [], "sql": s, "explanation": e, "tables": ["t"]})
    note = "Amounts keep the unit of the source table; sorry if you expected dollars. I cannot use the old view."
    kinds = {
        None: [full(SQL, note), f"Here is the query:\n```sql\n{SQL}\n```\nNotes: {note}", f"```sql\n{SQL}\n```", f"Question: {{q}}\n\n{full(SQL, note)}", SQL],
        "empty": [None, "", " \n", "N/A", "```json\n```", '{"sql": null}', "{}", "null", '{"sql": "", "explanation": ""}'],
        "refusal": ["I can't help with that request.", "{q}\nI must decline.", full(None, "My guidelines prevent me from answering."), "很遗憾，我无法回答这个问题。"],
        "copied_question": ["{q}", "> {q}", '{{"sql": "{q}", "explanation": ""}}', "{q}\n{q}"],
        "truncated": [full(SQL, note)[:120], f"Here is the query:\n```sql\n{SQL[:60]}", full(SQL[: SQL.index("GROUP")] + "AND", ""), f"Here is the query:\n```sql\n{SQL}\n```\nNotes: Amounts keep the un"],
        "other_language": [full(SQL, "Die Beträge behalten die Einheit der Quelle und werden nicht umgerechnet."), full(SQL, "金额沿用源表口径，未做币种换算。"), full(SQL, "金額は元の表の単位のままです。")],
    }
    out, i = [], 0
    for kind, texts in kinds.items():
        for t in texts * (40 if kind is None else 6):
            i += 1
            own = q.format(1000 + i)
            out.append((i, own, t and t.replace("{{", "{").replace("}}", "}").replace("{q}", own), kind))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1, 1) for r in rows], SCHEMA)
    return {r.key: r.defect for r in one_defect(defect_posteriors(answer_facts(df, "call_id", "question", "response"))).collect()}


def test_planted_defects_are_found(spark):
    data = pairs()
    got = found(spark, [r[:3] for r in data] + [data[0][:3]])
    assert got == {i: k for i, _, _, k in data if k}


def test_language_asked_for_and_odd_pairs(spark):
    good = '{"sql": "SELECT a FROM t", "explanation": "%s"}'
    en, zh = "The rows are grouped by the month and the filter is kept.", "金额沿用源表口径，未做币种换算。"
    data = pairs()
    extra = [(9001, "请统计销售额。请用英文说明。", good % en), (9002, "请统计销售额。请用英文说明。", good % zh), (9003, None, good % en), (9004, "", None), (9005, "Show the sales.", good % (en * 5000))]
    got = found(spark, [r[:3] for r in data] + extra)
    assert {k: got.get(k) for k in (9001, 9002, 9003, 9004, 9005)} == {9001: None, 9002: "other_language", 9003: None, 9004: "empty", 9005: None}


@pytest.mark.parametrize("text, want", [("帮我看一下ORG_2165各国家的回款率变化情况", "zh"), ("List ORG_2336's average ticket per month over Q4 2025, highest first.", "en"), ("Zeige die Bruttomarge von ORG_1 je Monat. Bitte auf Englisch antworten.", "en"), ("ORG_1 2026", None), ("", None)])
def test_languages(text, want):
    assert defects.expected_language(text) == want


def test_label_model_learns_who_is_right():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.1
    votes = np.stack([np.where(rng.random(4000) < a, y, rng.random(4000) < b).astype(float) for a, b in ((0.95, 0.01), (0.9, 0.02), (0.7, 0.02))], 1)
    votes[rng.random(votes.shape) < 0.2] = np.nan
    patterns, n = np.unique(np.nan_to_num(votes, nan=-1), axis=0, return_counts=True)
    model = LabelModel().fit(np.where(patterns < 0, np.nan, patterns), n.astype(float))
    p = model.posterior(votes)
    assert ((p > 0.5) == y).mean() > 0.96
    assert 0.2 <= defects.best_cutoff(p, np.ones(len(p))) <= 1


def test_two_good_functions_outweigh_one_that_votes_at_random():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.02
    votes = np.stack([np.where(rng.random(20_000) < 0.97, y, ~y).astype(float) for _ in range(2)] + [(rng.random(20_000) < 0.5).astype(float)], 1)
    votes[rng.random(20_000) > 0.1, 2] = np.nan
    model = LabelModel().fit(votes, np.ones(len(votes)))
    said = model.posterior(votes) > 0.5
    assert (said & y).sum() >= 0.9 * said.sum() and (said & y).sum() >= 0.9 * y.sum()
    assert model.yes[2] < 3 < 10 < model.yes[:2].min()


def test_functions_that_only_vote_for_do_not_flag_every_pair():
    rng = np.random.default_rng(2)
    y = rng.random(20_000) < 0.03
    votes = np.where(rng.random((20_000, 3)) < np.where(y, 0.8, 0.005)[:, None], 1.0, np.nan)
    model = LabelModel().fit(votes, np.ones(len(votes)))
    said = model.posterior(votes) > 0.5
    assert model.prior < 0.1 and said.sum() < 0.06 * len(y) and (said & y).sum() >= 0.9 * y.sum()


def test_read_answer_and_empty_table(spark):
    assert read_answer(None)["prose"] == "" and read_answer("text")["json"] is None
    assert read_answer('```json\n{"sql": "SELECT 1"}\n```')["sql"] == "SELECT 1"
    assert found(spark, []) == {}
