"""The bounded loop against a plain one, and tools as table functions."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from vellumgrid.functions import fixed as X
from vellumgrid.functions import table_tools
from vellumgrid.plans import agent


class Scripted:
    """Plays a request, which is a JSON list of responses; the last is repeated."""

    def plan(self, request, transcript):
        script = json.loads(request)
        return json.dumps(script[min(len(transcript), len(script) - 1)])


def field(name="benchmark", **more):
    return {"tool": "fund_disclosure", "input": json.dumps({"field": name, **more})}


def question(company, text="What were total assets?"):
    return {"tool": "company_question", "input": json.dumps({"company": company, "question": text})}


def uses(*calls):
    return {"stop": "tool_use", "calls": list(calls), "text": "thinking"}


def ends(*ids):
    return {"stop": "end_turn", "calls": [], "text": json.dumps({"evidence_ids": list(ids)})}


def plain(script, turns=6, most_tools=8, most_calls=12):
    """(status, turns, n_tools, n_calls, executed) of one request, in the plainest words."""
    n_tools = n_calls = said = 0
    memo, executed, evidence, repaired = {}, [], 0, False
    for turn in range(1, turns + 1):
        if n_calls >= most_calls:
            return "stopped", turn - 1, n_tools, n_calls, executed
        n_calls += 1
        r = script[min(said, len(script) - 1)]
        said += 1
        if r["stop"] == "end_turn":
            ids = json.loads(r["text"])["evidence_ids"]
            good = 1 <= len(ids) <= 8 and len(set(ids)) == len(ids) and all(1 <= int(i[1:]) <= evidence for i in ids)
            if not good and evidence and not repaired and ids:
                repaired = True
                continue
            return "done" if good else "refused", turn, n_tools, n_calls, executed
        if r["stop"] != "tool_use":
            return "refused", turn, n_tools, n_calls, executed
        if not r["calls"] or n_tools + len(r["calls"]) > most_tools:
            return "stopped", turn, n_tools, n_calls, executed
        n_tools += len(r["calls"])
        for call in r["calls"]:
            given = json.loads(call["input"])
            known = call["tool"] == "fund_disclosure" and given.get("field") in ("benchmark", "expense_ratio", "exit_load", "top_holdings") or call["tool"] == "company_question" and given.get("company") in ("BEL", "HCC")
            name = (call["tool"], json.dumps(given, sort_keys=True))
            if not known or name in memo:
                continue
            if call["tool"] == "company_question":
                if n_calls >= most_calls:
                    return "stopped", turn, n_tools, n_calls, executed
                n_calls += 1
            memo[name] = True
            executed.append(name)
            evidence += 1
    return "stopped", turns, n_tools, n_calls, executed


def scripts():
    rng = random.Random(5)
    fields = ["benchmark", "expense_ratio", "exit_load", "nonsense"]
    yield [uses(field()), ends("E1")]
    yield [uses(*[field(f) for f in ["benchmark"] * 9]), ends("E1")]  # nine at once: none runs
    yield [uses(field(), field("exit_load")), uses(*[field("expense_ratio")] * 6), uses(field()), ends("E1")]
    yield [uses(field()) for _ in range(7)]  # six turns
    yield [uses(*[question("BEL", f"q{t}{i}") for i in range(4)]) for t in range(3)]  # calls made by tools count, too
    yield [uses(*[question("BEL", f"q{t}{i}") for i in range(2)]) for t in range(2)] + [uses(question("HCC", "x"), question("HCC", "y"), question("HCC", "z"), question("HCC", "u")), ends("E2")]
    yield [uses(field()), ends("E7"), ends("E1")]  # repaired once
    yield [uses(field()), ends("E7"), ends("E8")]
    yield [ends()]
    yield [uses(field()), {"stop": "max_tokens", "calls": None, "text": "half an ans"}]
    yield [{"stop": "tool_use", "calls": [], "text": ""}]
    for _ in range(40):
        script = []
        for _ in range(rng.randint(0, 7)):
            script.append(uses(*[field(rng.choice(fields)) if rng.random() < 0.5 else question(rng.choice(["BEL", "HCC", "b ad"]), rng.choice("abcdef")) for _ in range(rng.choice([1, 1, 2, 2, 3, 4]))]))
        yield [*script, ends(*rng.sample(["E1", "E2", "E9"], rng.randint(0, 2)))]


def test_the_loop_equals_a_plain_one(spark):
    rows = [(i, json.dumps(s)) for i, s in enumerate(scripts())]
    requests = spark.createDataFrame(rows, "request_id int, request string").repartition(3)
    made = []

    def execute(calls):
        made.extend((r["request_id"], r["tool"], json.dumps(json.loads(r["input"]), sort_keys=True)) for r in calls.collect())
        return calls.select("request_id", "canonical", F.lit(0).alias("at"), F.lit("some text").alias("text"), F.lit("s").alias("source"))

    got = {r["request_id"]: r for r in agent.run(requests, Scripted, execute).collect()}
    expected = {i: plain(json.loads(s)) for i, s in rows}
    assert {i: (r["status"], r["turns"], r["n_tools"], r["n_calls"]) for i, r in got.items()} == {i: e[:4] for i, e in expected.items()}
    assert sorted(made) == sorted((i, *call) for i, e in expected.items() for call in e[4])
    assert all(r["n_calls"] <= X.MAX_CALLS and r["n_tools"] <= X.MAX_TOOLS and r["turns"] <= X.MAX_TURNS for r in got.values())
    assert got[1]["status"] == "stopped" and got[1]["n_tools"] == 0 and not [m for m in made if m[0] == 1]
    assert "some text" in got[0]["text"] and got[1]["text"] == X.REFUSAL
    assert {r["status"] for r in got.values()} == {"done", "refused", "stopped"}
    assert agent.run(requests.limit(0), Scripted, execute).count() == 0


def test_disclosures_through_the_loop(spark):
    struct = "struct<value:string,page:int>"
    snapshots = spark.createDataFrame([(1, "2026-09-30", "2026-08-31", "https://p", "https://f", ("Index", 4), ("0.23%", 29, "TER", "Total expense ratio.", "0.13%"), ("Nil", 30))], f"fund int, portfolio_date string, factsheet_date string, portfolio_url string, factsheet_url string, benchmark {struct}, expense_ratio struct<value:string,page:int,kind:string,definition:string,base_value:string>, exit_load {struct}")
    ranked = spark.createDataFrame([(1, f"N{i}", f"{20 - i}.00%", "P", i + 8, i, i <= 10) for i in range(1, 13)], "fund int, name string, weight_display string, sheet string, row int, rank int, eligible boolean")
    rows = [("a", json.dumps([uses(field(), field("top_holdings", count=2)), ends("E1", "E3")])), ("b", json.dumps([uses(field("exit_load")), ends("E1")])), ("c", json.dumps([uses(field("exit_load")), ends("E1")]) + " " * 3)]
    requests = spark.createDataFrame(rows, "request_id string, request string")
    funds = spark.createDataFrame([("a", 1), ("b", 1), ("z", 1)], "request_id string, fund int")
    got = {r["request_id"]: r for r in agent.run(requests, Scripted, agent.fund_disclosures(funds, snapshots, ranked)).collect()}
    assert got["a"]["ids"] == "E1,E3" and "Benchmark: Index. As of 2026-08-31 [factsheet page 4](https://f#page=4)." in got["a"]["text"] and "N2: 18.00%" in got["a"]["text"] and "N1" not in got["a"]["text"]
    assert "Exit load: Nil." in got["b"]["text"] and got["c"]["status"] == "refused"  # c has no fund, so nothing may be read


def test_tools_as_table_functions(spark):
    table_tools.register(spark)
    rows = spark.createDataFrame([(1, ["BEL", "HCC"], "BEL", "q"), (2, ["HCC"], "BEL", "q"), (3, None, "BEL", "q"), (4, ["BEL"], None, "q"), (5, ["BEL"], "BEL", "x" * 1001), (6, ["BEL"], "BEL", None)], "i int, filings array<string>, company string, question string")
    got = {r["i"]: (r["input"], r["error"]) for r in spark.sql("select i, t.* from {rows} r, lateral company_question(r.filings, r.company, r.question) t", rows=rows).collect()}
    assert json.loads(got[1][0]) == {"company": "BEL", "question": "q"} and got[1][1] is None
    assert all(got[i] == (None, "not a filing of this request") for i in (2, 3, 4)) and all(got[i][0] is None and "1000" in got[i][1] for i in (5, 6))
    # Constant arguments are refused when the query is analysed: nothing has run.
    for sql, says in [("company_question(array('HCC'), 'BEL', 'q')", "BEL is not a filing"), ("company_question('HCC', 'BEL', 'q')", "filings must be"), ("fund_disclosure(map(), 'd', 'u', 'nonsense')", "not one of")]:
        with pytest.raises(Exception, match=says):
            spark.sql(f"select * from {sql}")
    line = spark.sql("select * from fund_disclosure(map('expense_ratio', named_struct('value', '0.8%', 'page', 29, 'definition', 'Base expense ratio.')), '2026-09-30', 'https://f', 'expense_ratio')").first()
    assert line["line"] == "Direct-plan expense ratio: 0.8%. Base expense ratio. As of 2026-09-30 [factsheet page 29](https://f#page=29)."
    tools = table_tools.definitions(["HCC", "BEL"], True)
    assert [d["name"] for d in tools] == ["company_question", "fund_disclosure"] and tools[0]["input_schema"]["properties"]["company"]["enum"] == ["BEL", "HCC"]
    assert table_tools.definitions([], False) == []
