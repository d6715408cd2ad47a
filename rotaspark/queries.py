"""Registered queries of the matrix, partition, report and roofline operators, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotaspark.functions import bits as b
from rotaspark.functions import metrics as m
from rotaspark.operators import linear, report, roofline
from rotaspark.operators.iterate import Iterated, power_iterate, unrolled
from rotaspark.plans import schedule
from rotaspark.plans.apportion import apportion
from rotaspark.plans.pattern import Pattern
from rotaspark.sources import cells, formats, generated, results, tables
from rotaspark.sources.scratch import materialize, shared_dir
from rotaspark.sources.tables import CHECKSUMS_SQL, TIMES_SQL, count, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NATIONS = 25


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def u(n: int) -> str:
    return f"{n}::UBIGINT"


def sql_times(x: str, y: int) -> str:
    return f"(({x})::UHUGEINT * {y}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


def sql_plus(x: str, y: str) -> str:
    return f"((({x})::UHUGEINT + ({y})::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def sql_mix(source: str, x: str, out: str) -> str:
    """A subquery: source and the column out = mix(x)."""
    one = sql_times(f"xor({x}, ({x}) >> 30)", b.MULTIPLIERS[0])
    two = sql_times("xor(__1, __1 >> 27)", b.MULTIPLIERS[1])
    return f"(SELECT * EXCLUDE (__1, __2), xor(__2, __2 >> 31) AS {out} FROM (SELECT *, {two} AS __2 FROM (SELECT *, {one} AS __1 FROM {source})))"


def sql_signed(x: str) -> str:
    return f"(({x})::HUGEINT - CASE WHEN ({x}) >= 9223372036854775808::UBIGINT THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END)::BIGINT"


def sql_unit(x: str) -> str:
    return f"((({x}) >> 11)::DOUBLE * 1.1102230246251565e-16)"


# --- generation -------------------------------------------------------------

KEYS = "(SELECT o_orderkey, o_orderkey::UBIGINT AS x FROM orders)"


@query(f"SELECT o_orderkey, {sql_signed('m')} AS mixed FROM {sql_mix(KEYS, 'x', 'm')}")
def g_splitmix_mix(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", b.mix("o_orderkey").alias("mixed"))


DRAWS = f"(SELECT o_orderkey, {sql_plus(sql_times('o_orderkey', b.GAMMA), '111')} AS x FROM orders)"


@query(f"SELECT o_orderkey, {sql_signed('m')} AS draw, {sql_unit('m')} AS unit FROM {sql_mix(DRAWS, 'x', 'm')}")
def g_splitmix_unit(spark, sf_dir):
    """Draw number o_orderkey of the generator with seed 111."""
    x = b.draw(F.lit(111).cast("long"), "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", x.alias("draw"), b.unit(x).alias("unit"))


VECTOR = f"""vec AS (SELECT i, {sql_unit('m')} AS v FROM {sql_mix(
    f"(SELECT i, {sql_plus(sql_times('i + 1', b.GAMMA), u(111 ^ generated.VECTOR_SEED))} AS x FROM (SELECT unnest(range((SELECT count(*) FROM customer))) AS i))", 'x', 'm')})"""


@query(f"WITH {VECTOR} SELECT i, round(v / sqrt((SELECT sum(v * v) FROM vec)), 10) AS v FROM vec")
def g_init_vector(spark, sf_dir):
    """The initial unit vector with one element a customer."""
    x = linear.normalize(generated.raw_vector(spark, count(spark, sf_dir, "customer")))
    return x.select("i", F.round("v", 10).alias("v"))


SHAPE = "shape AS (SELECT (SELECT count(*) FROM part) AS n, (SELECT count(*) FROM lineitem) AS nz)"


@query(f"WITH {SHAPE} SELECT i AS row, (nz // n + CASE WHEN i < nz % n THEN 1 ELSE 0 END)::BIGINT AS nnz FROM shape, unnest(range(n)) AS r(i)")
def g_pattern_regular(spark, sf_dir):
    n, nz = count(spark, sf_dir, "part"), count(spark, sf_dir, "lineitem")
    return spark.range(n).select(F.col("id").alias("row"), Pattern(n, nz, "regular").nnz(F.col("id")).cast("long").alias("nnz"))


PATTERN = f"""{SHAPE}, weights AS (
  SELECT i, n, nz, CASE WHEN i < n // 10 THEN CASE WHEN i % 16 < 2 THEN 160 ELSE 40 END
    WHEN i < n // 4 THEN CASE WHEN i % 16 = 0 THEN 20 ELSE 10 END WHEN i < 3 * n // 5 THEN 3 ELSE 1 END::HUGEINT AS w
  FROM shape, unnest(range(n)) AS r(i)),
shares AS (SELECT *, sum(w) OVER () AS total, (nz - n)::HUGEINT * w AS ideal FROM weights),
floors AS (SELECT *, least((ideal // total)::BIGINT, n - 1) AS extra, ideal % total AS rest FROM shares),
ranked AS (SELECT *, (nz - n) - sum(extra) OVER () AS units,
  CASE WHEN extra < n - 1 THEN row_number() OVER (PARTITION BY extra < n - 1 ORDER BY rest DESC, i) END AS place FROM floors),
taken AS (SELECT *, 1 + extra + CASE WHEN place <= units THEN 1 ELSE 0 END AS k FROM ranked),
room AS (SELECT *, n - k AS free, nz - sum(k) OVER () AS unfilled FROM taken),
pattern AS (SELECT i, n, least(free, greatest(0, unfilled - coalesce(sum(free) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) + k AS nnz FROM room)"""


@query(f"WITH {PATTERN} SELECT i AS row, nnz::BIGINT AS nnz FROM pattern")
def g_pattern_irregular(spark, sf_dir):
    n, nz = count(spark, sf_dir, "part"), count(spark, sf_dir, "lineitem")
    return spark.range(n).select(F.col("id").alias("row"), Pattern(n, nz).nnz(F.col("id")).cast("long").alias("nnz"))


@query(f"WITH {PATTERN} SELECT i + 1 AS row, sum(nnz) OVER (ORDER BY i)::BIGINT AS ptr FROM pattern UNION ALL SELECT 0, 0")
def g_row_ptr(spark, sf_dir):
    return generated.row_pointers(spark, count(spark, sf_dir, "part"), count(spark, sf_dir, "lineitem"))


@query(f"""{SHAPE.replace("shape AS", "WITH shape AS", 1)}, weights AS (SELECT p_partkey AS i, n, nz, (p_size * p_size)::HUGEINT AS w FROM part, shape),
{PATTERN[PATTERN.index("shares AS"):]} SELECT i AS row, nnz::BIGINT AS nnz FROM pattern""")
def g_pattern_weights(spark, sf_dir):
    """As many nonzeros as line items, shared out to the parts by the square of their size."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), (F.col("p_size") * F.col("p_size")).alias("w"))
    return apportion(part, count(spark, sf_dir, "part"), count(spark, sf_dir, "lineitem"))


def _matrix_sql() -> str:
    seeds = sql_mix("(SELECT i, n, nnz::BIGINT AS k, (i + 1)::UBIGINT AS x FROM pattern)", "x", "m")
    rows = f"(SELECT i, n, k, xor({u(111)}, m) AS s FROM {seeds})"
    two = sql_mix(f"(SELECT *, {sql_plus('s', u(b.GAMMA * 2 % 2**64))} AS x2 FROM {rows})", "x2", "d2")
    three = sql_mix(f"(SELECT *, {sql_plus('s', u(b.GAMMA * 3 % 2**64))} AS x3 FROM {two})", "x3", "d3")
    odd = "SELECT *, (d2 % n::UBIGINT)::BIGINT AS start, greatest((d3 % n::UBIGINT)::BIGINT, 1) AS s0 FROM " + three
    odd = f"SELECT *, CASE WHEN s0 % 2 = 0 THEN CASE WHEN s0 + 1 < n THEN s0 + 1 ELSE 1 END ELSE s0 END AS s1 FROM ({odd})"
    stride = f"SELECT *, coalesce((list_filter(range(s1, s1 + 400, 2), lambda c: c < n AND gcd(c, n) = 1))[1], 1) AS stride FROM ({odd})"
    walk = f"SELECT i, s, k, t, (start + t * stride) % n AS col FROM ({stride}), unnest(range(k)) AS w(t)"
    kept = f"SELECT i, s, row_number() OVER (PARTITION BY i ORDER BY t) AS pos, col, k FROM ({walk}) WHERE col <> i"
    entries = f"SELECT i, s, 0::BIGINT AS pos, i AS col FROM ({stride}) UNION ALL SELECT i, s, pos, col FROM ({kept}) WHERE pos < k"
    values = sql_mix(f"(SELECT *, {sql_plus('s', sql_times('CASE WHEN pos = 0 THEN 1 ELSE pos + 3 END', b.GAMMA))} AS xv FROM ({entries}))", "xv", "dv")
    return f"WITH {PATTERN}, raw AS (SELECT i AS row, pos, col, 0.1::DOUBLE + 0.9::DOUBLE * {sql_unit('dv')} + CASE WHEN pos = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS val FROM {values})"


@query(f"{_matrix_sql()} SELECT row, pos, col, round(val / sqrt(sum(val * val) OVER (PARTITION BY row)), 9) AS val FROM raw")
def g_matrix_coo(spark, sf_dir):
    """The generated matrix with a row a part and a nonzero a line item."""
    a = generated.matrix(spark, count(spark, sf_dir, "part"), count(spark, sf_dir, "lineitem"))
    return a.withColumn("val", F.round("val", 9))


@query(f"""{_matrix_sql()}, a AS (SELECT row, val / sqrt(sum(val * val) OVER (PARTITION BY row)) AS val FROM raw)
SELECT p_brand, count(*) AS n_entries, round(sum(val), 6) AS weight FROM a JOIN part ON row = p_partkey WHERE row >= (SELECT count(*) FROM part) // 4 AND row < (SELECT count(*) FROM part) // 2 GROUP BY 1""")
def s_matrix_source(spark, sf_dir):
    """Entries of the second quarter of the rows by the brand of their part; the data source generates no others."""
    formats.register(spark)
    n, nz = count(spark, sf_dir, "part"), count(spark, sf_dir, "lineitem")
    a = spark.read.format("generated_matrix").options(n=n, nz=nz).load().filter((F.col("row") >= n // 4) & (F.col("row") < n // 2))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), "p_brand")
    return a.join(part, "row").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_entries"), F.round(F.sum("val"), 6).alias("weight"))


@query(f"WITH {VECTOR} SELECT c_mktsegment, count(*) AS n_elements, round(sum(v), 6) AS total, round(sum(v * c_acctbal), 2) AS weighted FROM vec JOIN customer ON i = c_custkey WHERE i >= (SELECT count(*) FROM customer) // 2 GROUP BY 1")
def s_vector_source(spark, sf_dir):
    """Draws for the second half of the customers by their segment."""
    formats.register(spark)
    n = count(spark, sf_dir, "customer")
    x = spark.read.format("generated_vector").options(n=n).load().filter(F.col("i") >= n // 2)
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), "c_mktsegment", "c_acctbal")
    return x.join(customers, "i").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_elements"), F.round(F.sum("v"), 6).alias("total"), F.round(F.sum(F.col("v") * F.col("c_acctbal")), 2).alias("weighted"))


@query(f"WITH {PATTERN} SELECT count(*) AS rows, sum(nnz)::BIGINT AS total_nnz, min(nnz)::BIGINT AS min_nnz, max(nnz)::BIGINT AS max_nnz, round(sum(nnz)::DOUBLE / count(*), 3) AS avg_nnz FROM pattern")
def g_matrix_stats(spark, sf_dir):
    n, nz = count(spark, sf_dir, "part"), count(spark, sf_dir, "lineitem")
    return generated.matrix_stats(generated.pattern_counts(spark, n, nz), n, nz)


# --- linear algebra ---------------------------------------------------------

TRADE = """raw AS (SELECT c_nationkey::BIGINT AS row, s_nationkey::BIGINT AS col, sum(l_extendedprice * (1 - l_discount)) AS val
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
a AS (SELECT row, col, val / sqrt(sum(val * val) OVER (PARTITION BY row)) AS val FROM raw),
x AS (SELECT i, (i + 1)::DOUBLE / 5525 ** 0.5 AS v FROM unnest(range(25)) AS r(i))"""


def _trade(spark, sf_dir) -> DataFrame:
    return linear.normalize_rows(tables.trade(spark, sf_dir))


def _trade_run(spark, sf_dir) -> Iterated:
    """500 iterations over the trade matrix, with the same bits however rows are dealt."""
    a = linear.normalize_rows(materialize(tables.trade(spark, sf_dir, exact=True), "trade"), exact=True)
    return power_iterate(a, generated.raw_vector(spark, NATIONS), NATIONS)


def _ramp(spark, n: int) -> DataFrame:
    """1, 2, ..., n, of unit length."""
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("v"))


def _start(spark) -> DataFrame:
    return _ramp(spark, NATIONS).withColumn("v", F.col("v") / F.lit(5525**0.5))


@query(f"WITH {TRADE} SELECT row AS i, round(sum(val * v), 8) AS v FROM a JOIN x ON col = i GROUP BY row")
def l_spmv(spark, sf_dir):
    return linear.spmv(_trade(spark, sf_dir), _start(spark), NATIONS).withColumn("v", F.round("v", 8))


@query(f"WITH {TRADE} SELECT (row + 19) % 25 AS i, round(sum(val * v), 8) AS v FROM a JOIN x ON col = i GROUP BY row")
def l_spmv_shifted(spark, sf_dir):
    return linear.spmv(_trade(spark, sf_dir), _start(spark), NATIONS, schedule.shift_step(NATIONS)).withColumn("v", F.round("v", 8))


SUPPLY = """s AS (SELECT l_partkey AS row, l_suppkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2),
sx AS (SELECT s_suppkey AS i, s_acctbal / 10000 AS v FROM supplier)"""


@query(f"WITH {SUPPLY} SELECT row AS i, round(sum(val * v), 8) AS v FROM s JOIN sx ON col = i GROUP BY row")
def l_spmv_supply(spark, sf_dir):
    """Ordered quantities by part and supplier times the suppliers' balances."""
    x = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_acctbal") / 10000).alias("v"))
    y = linear.spmv(tables.supply(spark, sf_dir), x, None)
    return y.withColumn("v", F.round("v", 8))


@query(f"WITH {SUPPLY}, y AS (SELECT row, sum(val * v) AS v FROM s JOIN sx ON col = i GROUP BY row) SELECT row AS i, round(v, 8) AS v, round(v / (SELECT sqrt(sum(v * v)) FROM y), 10) AS unit FROM y")
def l_spmv_measured(spark, sf_dir):
    """The same product and its length in one pass."""
    x = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_acctbal") / 10000).alias("v"))
    y, size = linear.spmv_measured(tables.supply(spark, sf_dir), x, None)
    return y.select("i", F.round("v", 8).alias("v"), F.round(F.col("v") / F.lit(size), 10).alias("unit"))


PRICES = "p AS (SELECT p_partkey AS i, p_retailprice / 1000 AS v FROM part), q AS (SELECT p_partkey AS i, p_size / 50.0::DOUBLE AS v FROM part)"


def _prices(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("i"), (F.col("p_retailprice") / 1000).alias("v")), part.select(F.col("p_partkey").alias("i"), (F.col("p_size") / F.lit(50.0)).alias("v"))


@query(f"WITH {PRICES} SELECT round(sum(p.v * q.v), 4) AS dot FROM p JOIN q USING (i)")
def l_dot(spark, sf_dir):
    return linear.dot(*_prices(spark, sf_dir)).select(F.round("dot", 4).alias("dot"))


@query(f"WITH {PRICES} SELECT round(sqrt(sum(v * v)), 6) AS norm FROM p")
def l_norm(spark, sf_dir):
    return linear.l2_norm(_prices(spark, sf_dir)[0]).select(F.round("norm", 6).alias("norm"))


@query(f"WITH {PRICES} SELECT i, round(v / sqrt((SELECT sum(v * v) FROM p)), 10) AS v FROM p")
def l_normalize(spark, sf_dir):
    return linear.normalize(_prices(spark, sf_dir)[0]).select("i", F.round("v", 10).alias("v"))


@query("""WITH s AS (SELECT (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM orders) AS k),
t AS (SELECT n, k, CASE WHEN (n // 16 + 17) % 2 = 0 THEN n // 16 + 18 ELSE n // 16 + 17 END % n AS m FROM s)
SELECT i AS iteration, i // 25 AS epoch, (i // 25) * CASE WHEN m = 0 THEN 1 ELSE m END % n AS shift FROM t, unnest(range(k)) AS r(i)""")
def l_shift_schedule(spark, sf_dir):
    """The rotation in force at each of as many iterations as there are orders."""
    return schedule.shift_schedule(spark, count(spark, sf_dir, "customer"), count(spark, sf_dir, "orders"))


K3 = f"""{TRADE}, y1 AS (SELECT row AS i, sum(val * v) AS v FROM a JOIN x ON col = i GROUP BY row),
y2 AS (SELECT (row + 19) % 25 AS i, sum(val * v) AS v FROM a JOIN y1 ON col = i GROUP BY row),
y3 AS (SELECT (row + 38) % 25 AS i, sum(val * v) AS v FROM a JOIN y2 ON col = i GROUP BY row),
z AS (SELECT i, v / sqrt((SELECT sum(v * v) FROM y3)) AS v FROM y3)"""


@query(f"WITH {K3} SELECT i, round(v, 8) AS v FROM z")
def l_power_k3(spark, sf_dir):
    """Three iterations with a rotation at each."""
    return unrolled(_trade(spark, sf_dir), _start(spark), NATIONS, 3, 1).withColumn("v", F.round("v", 8))


@query(f"WITH {K3} SELECT round(sum(val * p.v * q.v), 8) AS rayleigh FROM a JOIN z p ON a.col = p.i JOIN z q ON (a.row + 38) % 25 = q.i")
def l_rayleigh_k3(spark, sf_dir):
    a = _trade(spark, sf_dir)
    x = unrolled(a, _start(spark), NATIONS, 3, 1)
    return linear.rayleigh(a, x, NATIONS, 38 % NATIONS).select(F.round("rayleigh", 8).alias("rayleigh"))


def sql_power(n: str, a: str, x: str) -> str:
    """Recursive CTEs: power (k, i, v) holds iteration k's unit vector; a (row, col, val) and x (i, v) are given."""
    step = f"(SELECT CASE WHEN m % {n} = 0 THEN 1 ELSE m % {n} END FROM (SELECT CASE WHEN ({n} // 16 + 17) % 2 = 0 THEN {n} // 16 + 18 ELSE {n} // 16 + 17 END AS m))"
    return f"""power AS (SELECT 0 AS k, i, v / sqrt(sum(v * v) OVER ()) AS v FROM {x} UNION ALL
  SELECT k + 1, i, v / sqrt(sum(v * v) OVER ()) FROM (SELECT k, ({a}.row + {step} * (k // 25)) % {n} AS i, sum(val * v) AS v FROM power JOIN {a} ON {a}.col = i WHERE k < 500 GROUP BY k, {a}.row)),
last AS (SELECT i, v FROM power WHERE k = 500), final AS (SELECT {step} * 19 % {n} AS shift)"""


def sql_vector(n: str) -> str:
    return f"(SELECT i, {sql_unit('m')} AS v FROM {sql_mix(f"(SELECT i, {sql_plus(sql_times('i + 1', b.GAMMA), u(111 ^ generated.VECTOR_SEED))} AS x FROM (SELECT unnest(range({n})) AS i))", 'x', 'm')})"


TRADE_500 = f"""WITH RECURSIVE raw AS MATERIALIZED (SELECT c_nationkey::BIGINT AS row, s_nationkey::BIGINT AS col, sum(l_extendedprice * (1 - l_discount)) AS val
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
a AS MATERIALIZED (SELECT row, col, val / sqrt(sum(val * val) OVER (PARTITION BY row)) AS val FROM raw), x AS {sql_vector('25')}, {sql_power('25', 'a', 'x')}"""


@query(f"{TRADE_500} SELECT i, n_name, round(v, 8) AS v, row_number() OVER (ORDER BY v DESC, i)::INT AS place FROM last JOIN nation ON i = n_nationkey")
def l_power_500(spark, sf_dir):
    """500 iterations over the trade matrix, with the nations' names."""
    x = _trade_run(spark, sf_dir).x
    names = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i"), "n_name")
    return x.join(names, "i").select("i", "n_name", F.round("v", 8).alias("v"), F.row_number().over(Window.orderBy(F.desc("v"), "i")).alias("place"))


FINAL = sql_mix(sql_mix("(SELECT i, round(v * 1000000)::BIGINT::UBIGINT AS w, i::UBIGINT AS y FROM last)", "y", "m0"), "xor(w, m0)", "t")


@query(f"{TRADE_500} SELECT {sql_signed('bit_xor(t)')} AS checksum FROM {FINAL}")
def l_power_checksum(spark, sf_dir):
    """The checksum of the final vector in millionths."""
    return linear.whole_checksum(_trade_run(spark, sf_dir).x)


@query()
def l_power_bits(spark, sf_dir):
    """The checksum of the final vector's bits, as a run reports it."""
    return linear.checksum(_trade_run(spark, sf_dir).x)


@query(f"{TRADE_500} SELECT round(sum(val * p.v * q.v), 8) AS rayleigh, max(shift)::BIGINT AS final_row_shift FROM a JOIN last p ON a.col = p.i JOIN final ON true JOIN last q ON (a.row + shift) % 25 = q.i")
def l_rayleigh_500(spark, sf_dir):
    found = _trade_run(spark, sf_dir).result
    return found.select(F.round("rayleigh", 8).alias("rayleigh"), "final_row_shift")


PARTS = "(SELECT count(*) FROM part)"


@query(f"""{_matrix_sql().replace("WITH ", "WITH RECURSIVE ", 1)}, a AS MATERIALIZED (SELECT row, col, val / sqrt(sum(val * val) OVER (PARTITION BY row)) AS val FROM raw),
x AS {sql_vector(PARTS)}, {sql_power(PARTS, 'a', 'x')} SELECT i, round(v, 9) AS v FROM last""")
def l_power_generated(spark, sf_dir):
    """500 iterations over the generated matrix with a row a part and a nonzero a line item."""
    n, nz = count(spark, sf_dir, "part"), count(spark, sf_dir, "lineitem")
    x = power_iterate(generated.matrix(spark, n, nz), generated.raw_vector(spark, n), n).x
    return x.select("i", F.round("v", 9).alias("v"))


def sql_whole(x: str, places: int = 53) -> str:
    """The double nearest to the sum of x, which are multiples of 2**-places: whole numbers are summed, and rounded once."""
    s = f"sum(({x} * 2.0::DOUBLE ** {places})::HUGEINT)"
    return f"(({s} >> 40)::DOUBLE * 2.0::DOUBLE ** 40 + ({s} & 1099511627775)::DOUBLE) / 2.0::DOUBLE ** {places}"


def sql_bits(v: str) -> str:
    """The bits of a positive double from its exponent and mantissa."""
    e = f"(floor(log2({v})) + CASE WHEN {v} >= 2.0::DOUBLE ** (floor(log2({v})) + 1) THEN 1 WHEN {v} < 2.0::DOUBLE ** floor(log2({v})) THEN -1 ELSE 0 END)"
    return f"((({e} + 1023)::UBIGINT << 52) | (({v} * 2.0::DOUBLE ** (52 - {e}))::UBIGINT & 4503599627370495::UBIGINT))"


MARKS = sql_mix(sql_mix(f"(SELECT i, {sql_bits('v')} AS bits, i::UBIGINT AS y FROM unit)", "y", "m0"), "xor(bits, m0)", "t")


@query(f"""WITH {PRICES}, norm AS (SELECT sqrt({sql_whole('v * v')}) AS d FROM p), unit AS (SELECT i, v * (1.0::DOUBLE / d) AS v FROM p, norm)
SELECT lower(hex(bit_xor(t))) AS checksum FROM {MARKS}""")
def l_checksum_bits(spark, sf_dir):
    """The bits of the parts' prices as a unit vector, whose norm has no error but the last rounding."""
    return linear.checksum(linear.normalize_exactly(_prices(spark, sf_dir)[0]))


@query(f"WITH {PRICES} SELECT {sql_whole('p.v * q.v', 64)} AS dot FROM p JOIN q USING (i)")
def l_dot_exact(spark, sf_dir):
    return linear.exact_dot(*_prices(spark, sf_dir))


@query(f"WITH {PRICES} SELECT sqrt({sql_whole('v * v')}) AS norm FROM p")
def l_norm_exact(spark, sf_dir):
    return linear.exact_norm(_prices(spark, sf_dir)[0])


REVENUE = "SELECT l_suppkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem"


@query(f"SELECT l_suppkey, {sql_whole('revenue', 52)} AS total FROM ({REVENUE}) GROUP BY 1")
def l_sum_exact(spark, sf_dir):
    """Each supplier's revenue, the same bits for any order and number of tasks."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return linear.exact_sums(lines, "revenue", "l_suppkey")


WHOLE = sql_mix(f"(SELECT i, w, {{m}} AS m0 FROM {{src}})".format(m="m0", src=sql_mix(f"(SELECT p_partkey AS i, round(p_retailprice * 100)::BIGINT::UBIGINT AS w, p_partkey::UBIGINT AS y FROM part)", "y", "m0")), "xor(w, m0)", "t")


@query(f"SELECT {sql_signed('bit_xor(t)')} AS checksum FROM {WHOLE}")
def l_checksum_whole(spark, sf_dir):
    """The order-independent checksum of the parts' prices in cents."""
    return linear.whole_checksum(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v")), 2)


@query("SELECT i, round(b + 3 * c, 4) AS v FROM (SELECT p_partkey AS i, p_retailprice AS b, p_size::DOUBLE AS c FROM part)")
def r_triad(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.round(roofline.triad(F.col("p_retailprice"), F.col("p_size").cast("double")), 4).alias("v"))


# --- partitions -------------------------------------------------------------

PTR = """counts AS (SELECT p_partkey AS r, count(l_partkey) AS k FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1),
ptr AS (SELECT r, coalesce(sum(k) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM counts
  UNION ALL SELECT (SELECT count(*) FROM counts), (SELECT sum(k) FROM counts)),
edges AS (SELECT t, CASE WHEN t = 16 THEN (SELECT count(*) FROM counts) ELSE min(r) END AS lo
  FROM unnest(range(17)) AS q(t), ptr WHERE p >= (SELECT sum(k) FROM counts) * t // 16 GROUP BY t),
parts AS (SELECT t AS part, lo, lead(lo) OVER (ORDER BY t) AS hi FROM edges)"""


def _parts(spark, sf_dir, parts: int = 16) -> DataFrame:
    keys = read(spark, sf_dir, "part").select("p_partkey").distinct().count()
    return schedule.balanced_parts(tables.part_counts(spark, sf_dir), "row", "k", parts, keys, clamp=False)


@query(f"WITH {PTR} SELECT part::INT AS part, lo::BIGINT AS lo, hi::BIGINT AS hi, ((SELECT p FROM ptr WHERE r = hi) - (SELECT p FROM ptr WHERE r = lo))::BIGINT AS nnz FROM parts WHERE hi IS NOT NULL")
def p_nnz_partition(spark, sf_dir):
    """Sixteen ranges of parts with about equally many line items."""
    return _parts(spark, sf_dir)


@query("WITH c AS (SELECT p_partkey AS r, count(l_partkey) AS k, (SELECT greatest(1, count(*) // 128) FROM part) AS g FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) SELECT (r // g)::BIGINT AS chunk, min(r)::BIGINT AS lo, (max(r) + 1)::BIGINT AS hi, sum(k)::BIGINT AS nnz FROM c GROUP BY 1")
def p_grain_chunks(spark, sf_dir):
    """Line items over 128 ranges of parts of one width."""
    grain, _ = schedule.grain_chunks(count(spark, sf_dir, "part"), 16)
    counts = tables.part_counts(spark, sf_dir)
    return counts.groupBy(F.floor(F.col("row") / grain).cast("long").alias("chunk")).agg(F.min("row").alias("lo"), (F.max("row") + 1).alias("hi"), F.sum("k").alias("nnz"))


@query(f"""WITH {PTR}, b AS (SELECT part AS rank, lo, hi - lo AS len FROM parts WHERE hi IS NOT NULL)
SELECT c::INT AS chunk, rank::INT AS rank, (len // 4 + CASE WHEN c < len % 4 THEN 1 ELSE 0 END)::BIGINT AS cnt, (lo + (len // 4) * c + least(c, len % 4))::BIGINT AS displ FROM b, unnest(range(4)) AS q(c)""")
def p_chunk_plan(spark, sf_dir):
    """The sixteen balanced ranges of parts in four pieces each."""
    return schedule.chunk_plan(_parts(spark, sf_dir).withColumnRenamed("part", "rank"), 4)


# --- reports ----------------------------------------------------------------

TAGS = ["click", "error", "purchase", "signup", "view"]


def _times(spark, sf_dir) -> DataFrame:
    return tables.bench_times(spark, sf_dir)


SEQ = """seq AS (SELECT n, nz, round(median(time_sec), 6) AS seq_time, count(time_sec) AS n_samples FROM times WHERE tag = 'seq' GROUP BY 1, 2)"""
CELLS = f"""WITH {TIMES_SQL}, {SEQ}, cells AS (SELECT tag, n, nz, threads, round(median(time_sec), 6) AS time FROM times WHERE tag <> 'seq' GROUP BY ALL),
scaled AS (SELECT *, CASE WHEN time > 0 THEN seq_time / time END AS sp, max(CASE WHEN threads = 1 THEN time END) OVER (PARTITION BY tag, n, nz) AS one FROM cells LEFT JOIN seq USING (n, nz))"""


@query(f"WITH {TIMES_SQL} SELECT tag, n, nz, threads, round(median(time_sec), 6) AS time FROM times GROUP BY ALL")
def q_median(spark, sf_dir):
    return report.medians(_times(spark, sf_dir), "tag", "n", "nz", "threads")


@query(f"""{CELLS} SELECT tag, n, nz, threads, time, round(sp, 2) AS speedup, round(sp / threads, 2) AS efficiency,
  round(CASE WHEN time > 0 THEN one / time END, 2) AS scalability, round(CASE WHEN threads > 1 AND sp > 0 THEN (1 / sp - 1.0::DOUBLE / threads) / (1 - 1.0::DOUBLE / threads) END, 4) AS karp_flatt FROM scaled""")
def q_scaling(spark, sf_dir):
    return report.scaling(_times(spark, sf_dir))


@query(f"{CELLS} SELECT n, nz, threads, " + ", ".join(f"max(CASE WHEN tag = '{t}' THEN round(sp, 2) END) AS {t}" for t in TAGS) + " FROM scaled GROUP BY 1, 2, 3")
def q_pivot(spark, sf_dir):
    return report.side_by_side(_times(spark, sf_dir), TAGS)


CONSISTENT = f"""WITH {TIMES_SQL}, {CHECKSUMS_SQL}, found AS (SELECT n, nz, threads, src, list_position({TAGS}, tag) AS o, checksum FROM cksum WHERE tag <> 'seq'),
g AS (SELECT * FROM (SELECT DISTINCT n, nz, threads, src FROM found), unnest(range(1, 6)) AS q(o)),
f AS (SELECT g.*, checksum FROM g LEFT JOIN found USING (n, nz, threads, src, o)),
h AS (SELECT n, nz, threads, src, min(o) AS o1, arg_min(checksum, o) AS ref FROM f WHERE checksum IS NOT NULL GROUP BY ALL)"""


@query(f"{CONSISTENT} SELECT f.n, f.nz, f.threads, f.src, max(ref) AS reference, CASE WHEN count(*) FILTER (o > o1 AND coalesce(checksum, '') <> ref) > 0 THEN 'DIFF' ELSE 'match' END AS status FROM f LEFT JOIN h USING (n, nz, threads, src) GROUP BY 1, 2, 3, 4")
def q_checksum_consistency(spark, sf_dir):
    sums = tables.bench_checksums(spark, sf_dir)
    return report.checksum_consistency(sums, TAGS, "n", "nz", "threads", "src")


@query(f"WITH {TIMES_SQL}, {SEQ} SELECT * FROM seq")
def q_pooled_baseline(spark, sf_dir):
    return report.pooled_baseline(_times(spark, sf_dir))


@query(f"""WITH {TIMES_SQL}, each AS (SELECT src, n, nz, round(median(time_sec), 6) AS t FROM times WHERE tag = 'seq' GROUP BY ALL)
SELECT n, nz, count(t) AS n_sources, round(CASE WHEN min(t) > 0 THEN 100 * (max(t) - min(t)) / min(t) END, 2) AS spread_percent FROM each GROUP BY 1, 2 HAVING count(t) >= 2""")
def q_spread(spark, sf_dir):
    return report.spread(_times(spark, sf_dir))


HEADS = f"""WITH {TIMES_SQL}, cells AS (SELECT tag, n, nz, threads, round(median(time_sec), 6) AS time FROM times WHERE tag IN ('click', 'view') GROUP BY ALL),
heads AS (SELECT n, nz, threads, max(CASE WHEN tag = 'click' THEN time END) AS time_a, max(CASE WHEN tag = 'view' THEN time END) AS time_b FROM cells GROUP BY 1, 2, 3),
ratios AS (SELECT *, CASE WHEN time_b > 0 THEN time_a / time_b END AS ratio FROM heads)"""


@query(f"{HEADS} SELECT n, nz, threads, time_a, time_b, round(ratio, 8) AS ratio FROM ratios")
def q_head_to_head(spark, sf_dir):
    return report.head_to_head(_times(spark, sf_dir), "click", "view").withColumn("ratio", F.round("ratio", 8))


@query(f"{HEADS} SELECT n, nz, round(exp(avg(ln(ratio))), 6) AS geomean, count(*) AS n_ratios, count(*) FILTER (ratio > 1) AS slower, count(*) FILTER (ratio < 1) AS faster FROM ratios WHERE ratio > 0 GROUP BY 1, 2")
def q_geomean(spark, sf_dir):
    return report.geometric_mean(report.head_to_head(_times(spark, sf_dir), "click", "view"), "n", "nz")


@query(f"WITH {TIMES_SQL} SELECT DISTINCT 'threads' AS key, threads::VARCHAR AS value FROM times UNION SELECT 'n', n::VARCHAR FROM times UNION SELECT 'chunks', chunks::VARCHAR FROM times WHERE chunks IS NOT NULL")
def q_merged_grid(spark, sf_dir):
    return report.merged_grid(_times(spark, sf_dir), "threads", "n", "chunks")


GRID = f"""WITH {TIMES_SQL}, grid AS (SELECT * FROM (SELECT DISTINCT tag FROM times), (SELECT DISTINCT n FROM times), (SELECT DISTINCT nz FROM times), (SELECT DISTINCT threads FROM times), (SELECT DISTINCT ranks FROM times))"""


@query(f"{GRID} SELECT grid.*, round(median(time_sec), 6) AS time FROM grid LEFT JOIN times USING (tag, n, nz, threads, ranks) GROUP BY ALL")
def q_grid(spark, sf_dir):
    return report.complete(_times(spark, sf_dir), "tag", "n", "nz", "threads", "ranks")


@query(f"""WITH {TIMES_SQL}, o AS (SELECT tag, n, nz, threads, round(median(time_sec), 6) AS old_time FROM times WHERE src = 'run0' GROUP BY ALL),
w AS (SELECT tag, n, nz, threads, round(median(time_sec), 6) AS new_time FROM times WHERE src = 'run1' GROUP BY ALL)
SELECT o.*, new_time, round(CASE WHEN new_time > 0 THEN old_time / new_time END, 4) AS improvement, CASE WHEN old_time IS NULL OR new_time IS NULL THEN 'MISSING' ELSE 'ok' END AS status FROM o LEFT JOIN w USING (tag, n, nz, threads)""")
def q_compare_runs(spark, sf_dir):
    return report.compare_runs(_times(spark, sf_dir), "run0", "run1")


@query(f"""WITH {TIMES_SQL}, {SEQ}, c AS (SELECT src, tag, n, nz, threads, round(median(time_sec), 6) AS time FROM times WHERE tag <> 'seq' GROUP BY ALL),
s AS (SELECT n, nz, src, tag, threads, round(CASE WHEN time > 0 THEN seq_time / time END, 2) AS speedup FROM c JOIN seq USING (n, nz))
SELECT * FROM s WHERE speedup IS NOT NULL QUALIFY row_number() OVER (PARTITION BY n, nz, src, tag ORDER BY speedup DESC, threads) = 1""")
def q_leaderboard(spark, sf_dir):
    return report.leaderboard(_times(spark, sf_dir))


@query(f"""WITH {TIMES_SQL}, {SEQ}, c AS (SELECT n, nz, CASE WHEN chunks IS NULL THEN 'block' ELSE 'overlap' END AS variant, chunks, ranks, threads, round(median(time_sec), 6) AS time FROM times WHERE tag <> 'seq' GROUP BY ALL)
SELECT n, nz, variant, chunks, ranks, threads, ranks * threads AS cores, time, round(CASE WHEN time > 0 THEN seq_time / time END, 2) AS speedup,
  round(CASE WHEN time > 0 THEN seq_time / time END / (ranks * threads), 2) AS efficiency, round(CASE WHEN time > 0 THEN 6000.0::DOUBLE * nz / time / 1e9::DOUBLE END, 1) AS gbs FROM c LEFT JOIN seq USING (n, nz)""")
def q_geometry(spark, sf_dir):
    return report.geometry_report(_times(spark, sf_dir))


DUMPS = "a AS (SELECT l_orderkey AS i, sum(l_tax) AS v FROM lineitem WHERE l_linenumber < 5 GROUP BY 1), b AS (SELECT l_orderkey AS i, sum(l_tax) AS v FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)"


def _dumps(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Sums in the order of the file, since the last bit decides at the edge of a tolerance."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), "l_linenumber", "l_tax", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    return tuple(linear.ordered_sums(lines.filter(f), "l_tax", "place", "i").withColumnRenamed("total", "v") for f in ("l_linenumber < 5", "l_linenumber > 1"))


@query(f"""WITH {DUMPS}, s AS (SELECT count(a.v) AS n_a, count(b.v) AS n_b, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS n_common, max(abs(a.v - b.v)) AS d FROM a FULL JOIN b USING (i))
SELECT n_a, n_b, n_common, round(d, 8) AS max_abs_diff, CASE WHEN n_a <> n_b THEN 'different length' WHEN coalesce(d, 0) = 0 THEN 'identical' ELSE 'different' END AS verdict FROM s""")
def q_dump_diff(spark, sf_dir):
    return linear.compare_vectors(*_dumps(spark, sf_dir)).withColumn("max_abs_diff", F.round("max_abs_diff", 8))


VERDICTS = f"""WITH {DUMPS}, v AS (SELECT i, a.v AS a, b.v AS b, abs(a.v - b.v) / greatest(abs(a.v), 1e-300::DOUBLE) AS r FROM a FULL JOIN b USING (i)),
w AS (SELECT i, CASE WHEN r IS NULL THEN 'RUNERR' WHEN r <= 0.1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM v WHERE coalesce(a, b) > 0.001)"""


def _verdicts(spark, sf_dir) -> DataFrame:
    a, c = _dumps(spark, sf_dir)
    pairs = a.withColumnRenamed("v", "a").join(c.withColumnRenamed("v", "b"), "i", "full").filter(F.coalesce("a", "b") > 0.001)
    return report.tolerance_verdicts(pairs, 0.1)


@query(f"{VERDICTS} SELECT verdict, count(*) AS n_cases FROM w GROUP BY 1")
def q_tolerance(spark, sf_dir):
    return _verdicts(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n_cases"))


@query(f"{VERDICTS} SELECT count(*) AS n_cases, bool_and(verdict = 'PASS') AS ok FROM w")
def q_all_pass(spark, sf_dir):
    return report.all_pass(_verdicts(spark, sf_dir))


@query(f"""WITH {TIMES_SQL}, {CHECKSUMS_SQL}, r AS (SELECT n, nz, threads, max(checksum) AS reference FROM cksum WHERE tag = 'view' GROUP BY ALL),
t AS (SELECT tag, n, nz, threads, max(checksum) AS checksum FROM cksum WHERE tag <> 'view' GROUP BY ALL)
SELECT t.*, reference, CASE WHEN checksum = reference THEN 'match' ELSE 'DIFF' END AS status FROM t LEFT JOIN r USING (n, nz, threads)""")
def q_checksum_against(spark, sf_dir):
    return report.checksum_against(tables.bench_checksums(spark, sf_dir), "view", "n", "nz", "threads")


@query(f"{GRID} SELECT tag, n, nz, threads, ranks FROM grid LEFT JOIN times USING (tag, n, nz, threads, ranks) GROUP BY ALL HAVING count(time_sec) < 30")
def q_unfinished(spark, sf_dir):
    return report.unfinished(_times(spark, sf_dir), 30, "tag", "n", "nz", "threads", "ranks")


@query(f"{GRID} SELECT tag, n, nz, threads, ranks FROM grid LEFT JOIN times USING (tag, n, nz, threads, ranks) GROUP BY ALL HAVING count(times.rep) < 30")
def q_unfinished_any(spark, sf_dir):
    """Failed runs count as well."""
    return report.unfinished(_times(spark, sf_dir), 30, "tag", "n", "nz", "threads", "ranks", numeric=False)


PAIRS = [("click", "view"), ("error", "signup")]


@query(f"""WITH {TIMES_SQL}, {CHECKSUMS_SQL}, m AS (SELECT max(threads) AS threads FROM cksum), top AS (SELECT n, nz, threads, tag, max(checksum) AS checksum FROM cksum JOIN m USING (threads) GROUP BY ALL),
w AS (SELECT * FROM (SELECT DISTINCT n, nz FROM cksum), m, (VALUES {", ".join(map(str, PAIRS))}) p(base, other))
SELECT w.n, w.nz, w.threads, base, other, a.checksum AS base_checksum, b.checksum AS other_checksum, CASE WHEN a.checksum = b.checksum THEN 'match' ELSE 'DIFF' END AS status
FROM w LEFT JOIN top a ON a.n = w.n AND a.nz = w.nz AND a.tag = base LEFT JOIN top b ON b.n = w.n AND b.nz = w.nz AND b.tag = other""")
def q_checksum_pairs(spark, sf_dir):
    return report.checksum_pairs(tables.bench_checksums(spark, sf_dir), PAIRS)


@query(f"""WITH {TIMES_SQL}, {SEQ}, v AS (SELECT *, CASE tag WHEN 'error' THEN 'mpi_block' WHEN 'purchase' THEN 'mpi_overlap' ELSE tag END AS version,
  CASE tag WHEN 'error' THEN 'r' || ranks || 'xt' || threads WHEN 'purchase' THEN 'r' || ranks || 'xt' || threads || 'c' || chunks ELSE 't' || threads END AS config FROM times WHERE tag <> 'seq'),
c AS (SELECT src, version, n, nz, config, CASE WHEN starts_with(version, 'mpi_') THEN 0 ELSE threads END AS place, round(median(time_sec), 6) AS time FROM v WHERE config IS NOT NULL GROUP BY ALL),
s AS (SELECT n, nz, src, version, config, place, round(CASE WHEN time > 0 THEN seq_time / time END, 2) AS speedup, time FROM c JOIN seq USING (n, nz))
SELECT n, nz, src, version, config, speedup, time FROM s WHERE speedup IS NOT NULL QUALIFY row_number() OVER (PARTITION BY n, nz, src, version ORDER BY speedup DESC, place, config) = 1""")
def q_leaderboard_geometries(spark, sf_dir):
    return report.leaderboard_geometries(_times(spark, sf_dir), "error", "purchase")


@query(f"WITH {TIMES_SQL} SELECT DISTINCT threads, ranks, ceil(ranks / 2)::BIGINT AS nodes_needed FROM times WHERE threads <= 16 AND ceil(ranks / 2) <= 1")
def q_runnable(spark, sf_dir):
    return report.runnable(_times(spark, sf_dir).select("threads", "ranks").distinct(), 16, 1, F.lit(2))


@query(f"WITH {TIMES_SQL} SELECT src, n, nz, arg_min(tag, list_position(['signup', 'view', 'click'], tag)) AS tag FROM times WHERE tag IN ('signup', 'view', 'click') AND time_sec IS NOT NULL GROUP BY 1, 2, 3")
def q_preferred_tag(spark, sf_dir):
    return report.preferred_tag(_times(spark, sf_dir), ("signup", "view", "click"))


@query(f"WITH {TIMES_SQL} SELECT DISTINCT tag, CASE WHEN tag = 'seq' THEN 'sequential' ELSE tag END AS name FROM times")
def q_names(spark, sf_dir):
    return report.display_names(_times(spark, sf_dir))


@query(f"WITH {TIMES_SQL} SELECT src, CASE WHEN max(ranks) > 1 THEN 'mpi' WHEN max(threads) >= 1 THEN 'shared' ELSE 'unrecognised' END AS kind, count(DISTINCT (n, nz)) AS n_shapes FROM times GROUP BY 1")
def q_sources(spark, sf_dir):
    return report.classify_sources(_times(spark, sf_dir))


@query(f"WITH {TIMES_SQL} SELECT DISTINCT n, nz, round(nz / n, 1) AS density FROM times")
def q_shapes(spark, sf_dir):
    return report.shapes(_times(spark, sf_dir))


@query(f"""WITH {TIMES_SQL}, w AS (SELECT *, coalesce(sum(coalesce(time_sec, 0)) OVER (PARTITION BY src, tag ORDER BY rep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before FROM times)
SELECT src, tag, count(*) AS n_runs, round(sum(time_sec), 4) AS used FROM w WHERE used_before < 500 GROUP BY 1, 2""")
def q_time_budget(spark, sf_dir):
    return report.within_budget(_times(spark, sf_dir), 500)


@query("""WITH s AS (SELECT DISTINCT (p_size * 10)::VARCHAR || ':' || (p_size * 400)::VARCHAR AS t FROM part), r AS (SELECT DISTINCT (1 + o_custkey % 3)::VARCHAR || ':8' AS t FROM orders),
d AS (SELECT DISTINCT (1 + s_nationkey % 4)::INT AS nodes FROM supplier)
SELECT nodes, split_part(r.t, ':', 1)::INT AS rpn, split_part(r.t, ':', 2)::INT AS tpr, split_part(s.t, ':', 1)::BIGINT AS n, split_part(s.t, ':', 2)::BIGINT AS nz FROM d, r, s""")
def q_sweep(spark, sf_dir):
    shapes = read(spark, sf_dir, "part").select(F.concat((F.col("p_size") * 10).cast("string"), F.lit(":"), (F.col("p_size") * 400).cast("string")).alias("text")).distinct()
    splits = read(spark, sf_dir, "orders").select(F.concat((1 + F.col("o_custkey") % 3).cast("string"), F.lit(":8")).alias("text")).distinct()
    nodes = read(spark, sf_dir, "supplier").select((1 + F.col("s_nationkey") % 4).cast("int").alias("nodes")).distinct()
    return report.sweep(shapes, splits, nodes)


@query(f"WITH {TIMES_SQL}, {CHECKSUMS_SQL} SELECT n, nz, arg_min(checksum, (src, threads)) AS checksum FROM cksum WHERE tag = 'seq' AND checksum IS NOT NULL GROUP BY 1, 2")
def q_first_checksum(spark, sf_dir):
    return report.first_checksum(tables.bench_checksums(spark, sf_dir))


@query(f"""WITH {TIMES_SQL}, c AS (SELECT tag, n, nz, threads, round(median(time_sec), 6) AS time FROM times GROUP BY ALL)
SELECT tag, n, nz, threads, round(CASE WHEN time > 0 THEN 6000.0::DOUBLE * nz / time / 1e9::DOUBLE END, 4) AS gbs FROM c""")
def q_bandwidth(spark, sf_dir):
    cells = report.medians(_times(spark, sf_dir), "tag", "n", "nz", "threads")
    return cells.select("tag", "n", "nz", "threads", F.round(m.bandwidth(F.col("nz"), F.col("time")), 4).alias("gbs"))


# --- sources ----------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN value >= 2 THEN value END AS time_sec, CASE WHEN event_id % 4 <> 0 THEN '0x' || lower(hex(event_id + 255)) END AS checksum FROM
  (SELECT event_id, round(value, 6) AS value FROM events)""")
def s_log_parse(spark, sf_dir):
    """Logs written for the events and read back by the scan's patterns."""
    events = read(spark, sf_dir, "events").withColumn("value", F.round("value", 6))
    line = F.when(F.col("value") >= 2, F.format_string("Time (sec) = %s", F.col("value").cast("string"))).otherwise("crashed")
    check = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("checksum=0x"), F.lower(F.hex(F.col("event_id") + 255)))).otherwise("no sum")
    text = F.concat_ws("\n", F.col("event_type"), F.lit("rows=1"), check, line, F.lit("done"))
    found = results.parse_log(text)
    return events.select("event_id", found["time_sec"].alias("time_sec"), found["checksum"].alias("checksum"))


RUNS = f"""WITH {TIMES_SQL}, runs AS (SELECT tag, n, nz, threads, round(arg_max_null(time_sec, rep), 6) AS time_sec, max(rep) AS rep FROM times GROUP BY tag, n, nz, threads),
logs AS (SELECT *, CASE WHEN time_sec IS NOT NULL THEN '0x' || lower(hex(n + threads % 2)) END AS checksum, CASE WHEN time_sec IS NOT NULL THEN round(time_sec / 8, 6) END AS rayleigh FROM runs)"""


def _run_logs(spark, sf_dir) -> DataFrame:
    """The last run of each cell as a log, written and scanned."""
    last = _times(spark, sf_dir).groupBy("tag", "n", "nz", "threads").agg(F.round(F.max_by("time_sec", "rep"), 6).alias("time_sec"), F.max("rep").alias("rep"))
    one = F.lit(1).cast("long")
    text = results.log_text(F.upper("tag"), F.col("n"), F.col("nz"), one, F.col("threads").cast("long"), F.col("rep") / 1000, F.round(F.col("time_sec") / 8, 6), F.lower(F.hex(F.col("n") + F.col("threads") % 2)), F.col("time_sec"))
    name = F.format_string("%s_n%d_nz%d_t%d", "tag", "n", "nz", "threads")
    path = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    results.write_logs(last.select(name.alias("run"), text.alias("text")), path)
    return results.scan_logs(spark, path)


@query(f"""{RUNS} SELECT tag, n, nz, threads, n AS rows, nz AS total_nnz, 1::BIGINT AS min_nnz, threads::BIGINT AS max_nnz, round(nz / n, 3) AS avg_nnz, round(rep / 1000, 3) AS generation_time_sec, rayleigh, checksum, time_sec FROM logs""")
def s_log_scan(spark, sf_dir):
    columns = ["tag", "n", "nz", "threads", "rows", "total_nnz", "min_nnz", "max_nnz", "avg_nnz", "generation_time_sec", "rayleigh", "checksum", "time_sec"]
    return _run_logs(spark, sf_dir).select(*columns)


@query(f"""{RUNS}, ref AS (SELECT n, nz, min(time_sec) AS t, min(checksum) AS c FROM logs WHERE tag = 'seq' GROUP BY ALL)
SELECT tag, n, nz, threads, time_sec, CASE WHEN coalesce(time_sec, 0) <> 0 THEN round(t / time_sec, 2) END AS speedup, CASE WHEN coalesce(time_sec, 0) <> 0 THEN round(t / time_sec / threads * 100, 1) END AS percent_efficiency,
  CASE WHEN coalesce(time_sec, 0) = 0 THEN 'FAILED' WHEN checksum = c THEN 'match' ELSE 'MISMATCH' END AS status FROM logs LEFT JOIN ref USING (n, nz) WHERE tag <> 'seq'""")
def q_verification(spark, sf_dir):
    """Written logs against the sequential one's."""
    return report.verification(_run_logs(spark, sf_dir))


@query(f"WITH {TIMES_SQL} SELECT tag, n, nz, threads, round(time_sec, 6) AS time_sec, count(*) AS n_runs FROM times GROUP BY ALL")
def s_times_scan(spark, sf_dir):
    """All measurements written as files of samples and scanned."""
    path = f"{shared_dir(spark)}/times-{uuid.uuid4().hex}"
    name = F.format_string("%s_n%d_nz%d_t%d", "tag", "n", "nz", "threads")
    results.write_times(_times(spark, sf_dir).select(name.alias("run"), F.round("time_sec", 6).alias("time_sec")), path)
    return results.scan_times(spark, path).groupBy("tag", "n", "nz", "threads", F.round("time_sec", 6).alias("time_sec")).agg(F.count(F.lit(1)).alias("n_runs"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_totalprice AS v FROM orders")
def s_dump_scan(spark, sf_dir):
    """Order totals dumped in the order of their keys and read back by position."""
    path = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
    results.write_dump(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v")), path)
    return results.scan_dump(spark, path)


@query(f"""WITH {TIMES_SQL}, v AS (SELECT DISTINCT 'SIZES' AS key, n AS v FROM times UNION SELECT 'THREADS', threads FROM times UNION SELECT 'CHUNKS', chunks FROM times WHERE chunks IS NOT NULL)
SELECT key, string_agg(v::VARCHAR, ' ' ORDER BY v) AS joined FROM v GROUP BY 1""")
def s_config_scan(spark, sf_dir):
    """The settings of two sources merged, written and read back."""
    times = _times(spark, sf_dir)

    def settings(rows: DataFrame) -> DataFrame:
        parts = [rows.select(F.lit(k).alias("key"), F.col(c).cast("string").alias("v")) for k, c in (("SIZES", "n"), ("THREADS", "threads"), ("CHUNKS", "chunks"))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("key").agg(F.collect_set("v").alias("values"))

    path = f"{shared_dir(spark)}/config-{uuid.uuid4().hex}"
    results.write_config(results.merge_configs(settings(times.filter("src = 'run0'")), settings(times.filter("src <> 'run0'"))), path)
    found = results.scan_config(spark, path)
    return found.select("key", F.array_join("values", " ").alias("joined"))


SAMPLES = f"""WITH {TIMES_SQL}, given AS (SELECT src, tag, n, nz, threads, rep, round(time_sec, 6) AS time_sec, CASE WHEN rep % 4 <> 0 THEN '0x' || lower(hex(rep)) END AS checksum FROM times)"""


def _samples(spark, sf_dir) -> DataFrame:
    checksum = F.when(F.col("rep") % 4 != 0, F.concat(F.lit("0x"), F.lower(F.hex("rep"))))
    name = F.format_string("%s_n%d_nz%d_t%d", "tag", "n", "nz", "threads")
    return _times(spark, sf_dir).select("src", "tag", "threads", name.alias("run"), "rep", F.round("time_sec", 6).alias("time_sec"), checksum.alias("checksum"))


@query(f"""{SAMPLES}, again AS (SELECT * FROM given WHERE src = 'run1' AND threads <= 4), more AS (SELECT * FROM given WHERE src = 'run2' AND tag = 'view'),
kept AS (SELECT * FROM given WHERE src = 'run0' AND (tag, n, nz, threads) NOT IN (SELECT (tag, n, nz, threads) FROM again)),
now AS (SELECT *, 1 AS step FROM kept UNION ALL SELECT *, 2 FROM again UNION ALL SELECT *, 3 FROM more)
SELECT tag, n, nz, threads, count(*) AS n_samples, count(time_sec) AS n_times, round(sum(time_sec), 4) AS total, arg_max_null(checksum, (step, rep)) AS checksum FROM now GROUP BY ALL""")
def s_cell_rerun(spark, sf_dir):
    """Cells of one source written, half of them run again, some repeated further, and scanned."""
    path, given = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}", _samples(spark, sf_dir)
    cells.replace_cells(given.filter("src = 'run0'"), path)
    cells.replace_cells(given.filter("src = 'run1' and threads <= 4"), path)
    cells.append_cells(given.filter("src = 'run2' and tag = 'view'"), path)
    key = ["tag", "n", "nz", "threads"]
    # Cells meet by name, so names are taken apart once a cell and not for each of its lines.
    times = cells.scan_cells(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("n_samples"), F.count("time_sec").alias("n_times"), F.round(F.sum("time_sec"), 4).alias("total"))
    return times.join(cells.scan_checksums(spark, path), "file").select(*key, "n_samples", "n_times", "total", "checksum")


@query(f"""{SAMPLES}, first AS (SELECT * FROM given WHERE src = 'run0' AND threads > 2)
SELECT DISTINCT tag, n, nz, threads FROM given LEFT JOIN (SELECT tag, n, nz, threads, count(time_sec) AS k FROM first GROUP BY ALL) USING (tag, n, nz, threads) WHERE coalesce(k, 0) < 20""")
def s_cells_unfinished(spark, sf_dir):
    """The cells that a second start has to run again: fewer than twenty times in the files."""
    path, given = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}", _samples(spark, sf_dir)
    cells.replace_cells(given.filter("src = 'run0' and threads > 2"), path)
    left = cells.unfinished_cells(spark, path, given, 20)
    found = results.dimensions(F.col("run"))
    return left.select(*[found[k].alias(k) for k in ("tag", "n", "nz", "threads")])


@query(f"""WITH {TIMES_SQL}, v AS (SELECT DISTINCT 'SIZES' AS key, n AS v FROM times WHERE threads <= 8 UNION SELECT 'THREADS', threads FROM times WHERE src <> 'run2' UNION SELECT 'CHUNKS', max(chunks) FROM times WHERE src = 'run1' UNION SELECT 'RANKS', max(ranks) FROM times WHERE src = 'run0')
SELECT key, string_agg(v::VARCHAR, ' ' ORDER BY v) AS joined FROM v GROUP BY 1""")
def s_config_merge(spark, sf_dir):
    """Settings of two sources merged into one file, which is replaced whole each time."""
    times, path = _times(spark, sf_dir), f"{shared_dir(spark)}/settings-{uuid.uuid4().hex}.env"

    def settings(rows: DataFrame, last: str) -> DataFrame:
        parts = [rows.filter("threads <= 8").select(F.lit("SIZES").alias("key"), F.col("n").cast("string").alias("v")), rows.select(F.lit("THREADS"), F.col("threads").cast("string")), rows.agg(F.max(last).cast("string").alias("v")).select(F.lit(last.upper()), "v")]
        return parts[0].union(parts[1]).union(parts[2]).groupBy("key").agg(F.collect_set("v").alias("values"))

    cells.merge_config(settings(times.filter("src = 'run0'"), "ranks"), path, "SIZES", "THREADS")
    cells.merge_config(settings(times.filter("src = 'run1'"), "chunks"), path, "SIZES", "THREADS")
    return results.scan_config(spark, path).select("key", F.array_join("values", " ").alias("joined"))


@query(f"""WITH {TIMES_SQL} SELECT rep, tag, n, nz, threads, CASE WHEN rep % 2 = 0 THEN ranks END AS ranks, CASE WHEN rep % 2 = 0 THEN chunks END AS chunks,
  CASE WHEN rep % 2 = 0 AND chunks IS NOT NULL THEN 'overlap' WHEN rep % 2 = 0 THEN 'block' END AS variant FROM times""")
def s_name_parse(spark, sf_dir):
    """File names written for the measurements and taken apart again."""
    part = lambda mark, c: F.when(F.col(c).isNotNull() & (F.col("rep") % 2 == 0), F.concat(F.lit(mark), F.col(c).cast("string"))).otherwise("")
    name = F.concat("tag", F.lit("_n"), F.col("n").cast("string"), F.lit("_nz"), F.col("nz").cast("string"), part("_r", "ranks"), F.lit("_t"), F.col("threads").cast("string"), part("_c", "chunks"), F.lit(".times"))
    named = _times(spark, sf_dir).select("rep", name.alias("name"))
    return named.select("rep", *[c.alias(k) for k, c in results.dimensions(F.col("name")).items()])


@query("SELECT p_partkey, 'SIZES' || p_partkey::VARCHAR AS key, p_size::VARCHAR || ' ' || p_brand AS joined, len(string_split(p_size::VARCHAR || ' ' || p_brand, ' '))::INT AS n_values FROM part")
def s_config_parse(spark, sf_dir):
    line = F.concat(F.lit("SIZES"), F.col("p_partkey").cast("string"), F.lit('="'), F.col("p_size").cast("string"), F.lit(" "), F.col("p_brand"), F.lit('"'))
    found = results.parse_config(line)
    return read(spark, sf_dir, "part").select("p_partkey", found["key"].alias("key"), F.array_join(found["values"], " ").alias("joined"), F.size(found["values"]).alias("n_values"))


@query(f"WITH {TIMES_SQL}, {CHECKSUMS_SQL} SELECT * FROM cksum")
def s_latest_checksums(spark, sf_dir):
    return tables.bench_checksums(spark, sf_dir)


# --- roofline ---------------------------------------------------------------

KERNELS = "k AS (SELECT l_suppkey, count(*) AS nnz, count(DISTINCT l_partkey) AS n, sum(l_extendedprice) / 1e9::DOUBLE AS seconds, 287.3::DOUBLE AS pf, 49.2::DOUBLE AS pb FROM lineitem GROUP BY 1)"


def _kernels(spark, sf_dir) -> DataFrame:
    k = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("nnz"), F.countDistinct("l_partkey").alias("n"), (F.sum("l_extendedprice") / 1e9).alias("seconds"))
    _, gflops, gbs = roofline.CEILINGS[-1]
    return k.withColumns({"peak_gflops": F.lit(gflops), "peak_gbs": F.lit(gbs)})


@query(f"""WITH {KERNELS} SELECT l_suppkey, round(2.0::DOUBLE * (nnz + n) / seconds / 1e9::DOUBLE, 6) AS gflops, round(2.0::DOUBLE * (nnz + n) / (20.0::DOUBLE * nnz + 16 * n), 6) AS ai,
  round(2.0::DOUBLE * (nnz + n) / (12.0::DOUBLE * nnz + 16 * n), 6) AS ai_cached, round(least(pf, pb * (2.0::DOUBLE * (nnz + n) / (20.0::DOUBLE * nnz + 16 * n))), 6) AS roof, round(pf / pb, 6) AS ridge,
  round((12.0::DOUBLE * nnz + 16 * n) / seconds / 1e9::DOUBLE, 6) AS dram_gbs, CASE WHEN 2.0::DOUBLE * (nnz + n) / (20.0::DOUBLE * nnz + 16 * n) < pf / pb THEN 'memory' ELSE 'compute' END AS bound FROM k""")
def r_roofline_model(spark, sf_dir):
    """Each supplier's lines as one kernel run; its seconds are an input, here what the lines cost in thousand millions."""
    return roofline.roofline(_kernels(spark, sf_dir)).select("l_suppkey", "gflops", "ai", "ai_cached", "roof", "ridge", "dram_gbs", "bound")


@query(f"WITH {KERNELS} SELECT l_suppkey, round(n / seconds / 1e9::DOUBLE, 6) AS k2_gflops, round(16.0::DOUBLE * n / seconds / 1e9::DOUBLE, 6) AS k2_gbs FROM k")
def r_scale_model(spark, sf_dir):
    return roofline.scale_model(_kernels(spark, sf_dir)).select("l_suppkey", "k2_gflops", "k2_gbs")


def sql_first(rows: list[tuple], place: int, value: int, kind: str) -> str:
    whens = " ".join(f"WHEN kb <= {r[place]}::DOUBLE THEN {r[value]!r}{kind}" for r in rows[:-1])
    return f"CASE {whens} ELSE {rows[-1][value]!r}{kind} END"


@query(f"""WITH c AS (SELECT p_brand, count(*) AS nnz, count(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
k AS (SELECT *, (12.0::DOUBLE * nnz + 16 * n) / 1024 AS kb FROM c UNION ALL SELECT 'all', sum(nnz), sum(n), (12.0::DOUBLE * sum(nnz) + 16 * sum(n)) / 1024 FROM c),
w AS (SELECT *, {sql_first(roofline.LEVELS, 2, 0, "")} AS level, {sql_first(roofline.LEVELS, 2, 1, "::DOUBLE")} AS level_gbs, {sql_first(roofline.SWEEP, 0, 1, "::DOUBLE")} AS sweep_gbs FROM k)
SELECT p_brand, round(kb, 4) AS working_kb, level, level_gbs, sweep_gbs, round(least(287.3::DOUBLE, level_gbs * (2.0::DOUBLE * (nnz + n) / (12.0::DOUBLE * nnz + 16 * n))), 6) AS level_roof FROM w""")
def r_memory_levels(spark, sf_dir):
    """The lines of each brand's parts, and all of them, as matrices: which level of memory holds them, and how fast it is."""
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    each = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("nnz"), F.countDistinct("l_partkey").alias("n"))
    every = each.agg(F.lit("all").alias("p_brand"), F.sum("nnz").alias("nnz"), F.sum("n").alias("n"))
    found = roofline.memory_level(each.unionByName(every))
    return found.select("p_brand", F.round("working_kb", 4).alias("working_kb"), "level", "level_gbs", "sweep_gbs", F.round("level_roof", 6).alias("level_roof"))


@query()
def r_product_timed(spark, sf_dir):
    """The model over measured times of the product of ordered quantities and the suppliers' balances."""
    x = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_acctbal") / 10000).alias("v"))
    runs = roofline.timed_product(tables.supply(spark, sf_dir), x)
    return roofline.scale_model(roofline.roofline(runs))
