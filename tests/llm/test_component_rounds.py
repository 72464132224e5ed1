from shardloom.llm import components as C


def test_rounds_copy_no_link(rows, monkeypatch):
    plans = []
    write = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name: (
        plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    links = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(20, 60)] + [(100, 101), (102, 101), (103, 103)]
    found = C.components(rows("u bigint, v bigint", links)).collect()
    want = {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert sorted((r["node"], r["root"]) for r in found) == sorted(want.items())
    assert len(plans) > 1 and not any("Generate" in plan for plan in plans)
