import duckdb

SF_DIR = "/root/testdata/sf0.001"


def table(name, sf_dir=SF_DIR):
    con = duckdb.connect()
    return con.execute(f"SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')").fetchall()


def documents(spark, rows, extra=True):
    """Documents from (doc_id, text) with columns whose names clash with those that operators make."""
    schema = "doc_id long, text string"
    if not extra:
        return spark.createDataFrame(rows, schema)
    schema += ", digest string, salt int, row long, token string, rule string, shard int, size string, lang string, source string"
    return spark.createDataFrame([(*r, "x", 1, 2, "t", "r", 3, "s", "en", "src0") for r in rows], schema)


def collected(df):
    return [tuple(r) for r in df.collect()]
