"""Runs a query on Spark and its SQL on DuckDB and compares all rows."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9) + 0.0
        return v

    return sorted(names), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def _kind(name):
    name = name.lower()
    return {"bigint": "long", "integer": "int", "hugeint": "huge", "varchar": "string", "double": "double"}.get(name, name)


def compare(df, con, sql):
    """The difference as text, empty when both sides agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: _kind(str(d[1])) for d in result.description}
    mine = {f.name: _kind(f.dataType.typeName().replace("integer", "int")) for f in df.schema.fields}
    want_names, want = _rows(names, result.fetchall())
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if want_names != got_names:
        return f"columns {got_names} instead of {want_names}"
    if kinds != mine:
        return f"types {mine} instead of {kinds}"
    if want == got:
        return "" if want else "both are empty"
    lost = [r for r in want if r not in set(got)] if len(want) < 5000 else want
    extra = [r for r in got if r not in set(want)] if len(got) < 5000 else got
    return f"rows {len(got)} instead of {len(want)}; missing {str(lost[:2])[:700]}; extra {str(extra[:2])[:700]}"
