def rows(df, *columns):
    """Rows as tuples in the given column order, sorted with None first."""
    out = [tuple(r) for r in df.select(*(columns or df.columns)).collect()]
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def one(df):
    return df.collect()[0].asDict()


def by_key(df, key, value):
    return {r[key]: r[value] for r in df.select(key, value).collect()}


def plan(df):
    """Physical plan text, before execution."""
    return df._jdf.queryExecution().executedPlan().toString()
