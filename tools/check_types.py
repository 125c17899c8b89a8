"""Compare each query's Spark output types with its DuckDB SQL result types."""
import sys; import os; sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb
from vintage.session import get_spark
from vintage.plans import catalog as C
from pyspark.sql import types as T
sf = sys.argv[1] if len(sys.argv) > 1 else '/root/testdata/sf0.001'
spark=get_spark('types', cpus=8)
con=duckdb.connect()
for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
def m(dt):
    if isinstance(dt, T.LongType): return 'BIGINT'
    if isinstance(dt, T.IntegerType): return 'INTEGER'
    if isinstance(dt, T.DoubleType): return 'DOUBLE'
    if isinstance(dt, T.FloatType): return 'FLOAT'
    if isinstance(dt, T.StringType): return 'VARCHAR'
    if isinstance(dt, T.DateType): return 'DATE'
    if isinstance(dt, T.BooleanType): return 'BOOLEAN'
    if isinstance(dt, T.ArrayType): return m(dt.elementType)+'[]'
    return str(dt)
for n, sql in C.ORACLE.items():
    sdf = C.QUERIES[n](spark, sf)
    st = {f.name: m(f.dataType) for f in sdf.schema.fields}
    dt = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    bad = {k: (st.get(k), dt.get(k)) for k in set(st) | set(dt) if st.get(k) != dt.get(k)}
    if bad: print(n, bad)
print('done')
