"""Every registered query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


def norm(v):
    return "None" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = con.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = sorted("|".join(norm(r[names.index(c)]) for c in columns) for r in got.fetchall())
    assert sorted("|".join(norm(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_graph_queries_of_all_line_items(spark, con):
    """Against plain Python over the whole table, in which programs form one large cycle."""
    programs = [s for (s,) in con.execute("SELECT s_suppkey FROM supplier").fetchall()]
    edges = {(s, p % len(programs)) for s, p in con.execute("SELECT l_suppkey, l_partkey FROM lineitem").fetchall() if s != p % len(programs)}
    run = lambda q: entry.queries()[q](spark, SF)
    name = "u{:06d}".format
    after = {a: {b for x, b in edges if x == a} for a in programs}
    reach = {a: {a} for a in programs}
    for _ in programs:
        reach = {a: reach[a].union(*(reach[b] for b in after[a])) for a in programs}
    same = {a: [b for b in programs if b in reach[a] and a in reach[b]] for a in programs}
    cluster = {a: f"cluster-{name(min(m))}" if len(m) > 1 else name(a) for a, m in same.items()}
    assert max(len(m) for m in same.values()) > 1
    assert {r["id"]: r["cluster"] for r in run("scc").collect()} == {name(a): c for a, c in cluster.items()}
    nation = dict(con.execute("SELECT s_suppkey, s_nationkey FROM supplier").fetchall())
    paths = {name(a): ",".join(dict.fromkeys(f"src/{nation[b]}.py" for b in sorted(after[a]))) for a in programs if after[a]}
    assert {r["unit_id"]: r["paths"] for r in run("context_paths").collect()} == paths


def test_plans_of_clusters_of_many_sizes(spark, con):
    """Against plain Python over all line items: cycles of several sizes in layers, units that are no suppliers left out of the plan."""
    programs = {s for (s,) in con.execute("SELECT s_suppkey FROM supplier").fetchall()}
    group = lambda x: x // 12 * 4 + (x % 12 >= 1) + (x % 12 >= 3) + (x % 12 >= 6)
    turned = lambda a, b: (b, a) if group(a) < group(b) else (a, b)
    items = con.execute("SELECT l_suppkey, l_partkey FROM lineitem").fetchall()
    near = {turned(s, s - s % 12 + p % 12) for s, p in items}
    edges = near | {turned(s, p % len(programs)) for s, p in items}
    # no pair of units that line items name is left out
    assert {frozenset((s, p % len(programs))) for s, p in items} <= {frozenset(e) for e in edges}
    name = "u{:06d}".format
    run = lambda q: entry.queries()[q](spark, SF)

    def components(edges):
        nodes = {x for a, b in edges if a != b for x in (a, b)}
        reach = {a: {a} for a in nodes}
        for _ in range(12):
            reach = {a: reach[a].union(*(reach[b] for x, b in edges if x == a)) for a in nodes}
        same = {a: {b for b in reach[a] if a in reach[b]} for a in nodes}
        return same, {a: f"cluster-{name(min(m))}" if len(m) > 1 else name(a) for a, m in same.items()}

    assert {r["id"]: r["cluster"] for r in run("scc_clusters").collect()} == {name(a): c for a, c in components(near)[1].items()}
    same, cluster = components(edges)
    assert len({len(m) for m in same.values()}) > 2
    between = {(cluster[a], cluster[b]) for a, b in edges if a != b and cluster[a] != cluster[b]}
    assert {(r["source"], r["target"]) for r in run("condensation").collect()} == between and between
    known = {cluster.get(a, name(a)) for a in programs}
    height: dict = {}
    while len(height) < len(known):
        height |= {c: max((1 + height[b] for x, b in between if x == c and b in known), default=0) for c in known if all(b in height for x, b in between if x == c and b in known)}
    for q in ("waves", "waves_by_seam"):
        assert {r["unit_id"]: (r["cluster"], r["wave"]) for r in run(q).collect()} == {name(a): (cluster.get(a, name(a)), height[cluster.get(a, name(a))] + 1) for a in programs}
    assert max(height.values()) > 1


def test_descendants_of_every_program(spark, con):
    got = {r["root"] for r in entry.queries()["kg_descendants"](spark, SF).select("root").distinct().collect()}
    assert got == {f"prog:{s}" for (s,) in con.execute("SELECT s_suppkey FROM supplier").fetchall()}


def test_job_control_has_a_step_for_every_line_number(spark, con):
    got = {(r["job"], r["step"]) for r in entry.queries()["jcl_facts"](spark, SF).where("kind = 'step'").collect()}
    assert got == {(f"JOB{s}", f"STEP{n}") for s, n in con.execute("SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem").fetchall()}
    assert max(n for _, n in got) > "STEP3"
