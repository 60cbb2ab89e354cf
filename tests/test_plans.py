"""Plan guards: no query builds pairs with a nested-loop or Cartesian join,
and scans read only the columns a query uses."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loop_or_cartesian_joins(spark):
    offenders = {}
    from skein.plans.catalog import QUERIES, load_all

    load_all()
    for name, fn in QUERIES.items():
        plan = _plan(fn(spark, SF))
        bad = [w for w in ("NestedLoop", "Cartesian") if w in plan]
        if bad:
            offenders[name] = bad
    assert offenders == {}


def test_scans_are_pruned(spark):
    qs = E.queries()
    plan = _plan(qs["json_is_valid"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,props:string>" in plan
    plan = _plan(qs["grant_audit"](spark, SF))
    assert "struct<o_orderkey:bigint,o_custkey:bigint,o_orderpriority:string>" in plan
    assert "struct<c_custkey:bigint,c_mktsegment:string>" in plan
