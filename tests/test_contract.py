import json

import pyarrow.parquet as pq

from semspark.operators.contract import findings
from semspark.queries.reference import CONTRACT, contract_findings

SCHEMA = "call_id long, response string"
WHOLE = {"assumptions": [], "columns": [], "explanation": "a } b", "sql": "SELECT 1", "tables": [{"x": {}}]}


def brute(text):
    value = (text or "").strip()
    if value.startswith("```"):
        lines = value.splitlines()[1:]
        value = "\n".join(lines[:-1] if lines and lines[-1].strip() == "```" else lines).strip()
    try:
        found = json.loads(value)
    except json.JSONDecodeError:
        if "{" not in value:
            return None, None, False, "absent"
        try:
            found = json.JSONDecoder().raw_decode(value[value.find("{") :])[0]
        except json.JSONDecodeError:
            return None, None, False, "unparsable"
    if not isinstance(found, dict):
        return None, None, False, "not_object"
    extra, missing, sql = len(set(found) - set(CONTRACT)), len(set(CONTRACT) - set(found)), isinstance(found.get("sql"), str)
    return extra, missing, sql, "fields" if extra or missing else None if sql else "no_sql"


def test_each_response_has_a_row(spark):
    j = json.dumps(WHOLE)
    texts = [j, f"```json\n{j}\n```", f"Here:\n```json\n{j}\n```\nDone {{x}}.", j[:40], f"```\n{j[:60]}", "no object", "", None, " \n", "[1, 2]", "{}", "7", "{", "}{", "```json\n```"]
    texts += [json.dumps(WHOLE | {"sql": None}), json.dumps(WHOLE | {"sql": 5}), "So: " + json.dumps(WHOLE | {"more": 1}) + "}", "{a} " + j, f"```json {j}\n```"]
    df = spark.createDataFrame([*enumerate(texts), (0, j)], SCHEMA)
    got = {r.key: tuple(r)[1:] for r in findings(df, "call_id", "response", CONTRACT).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert findings(df.limit(0), "call_id", "response", CONTRACT).count() == 0


def test_each_call_has_a_row(spark, small, rows):
    t = pq.read_table(f"{small}/query_writer_calls.parquet", columns=["call_id", "response"]).to_pydict()
    want = {(c, *brute(r)) for c, r in set(zip(t["call_id"], t["response"], strict=True))}
    got = contract_findings(spark, small).collect()
    assert {tuple(r) for r in got} == want
