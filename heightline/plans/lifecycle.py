"""The life of passes with their energy as a query, and its twin, which walks inheritance by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heightline.operators import fsm, ledger
from heightline.sources import testdata as T

OWNERS = 37
#: Orders within a block of what follows a mint, above those of mints.
MOVED, BURNED = 50_000_000, 60_000_000


def events(s: SparkSession, d: str, claims: bool) -> DataFrame:
    """Every event of the history mints a pass for one of OWNERS owners, one in eleven an invalid one.

    Some move a block later to the same owner or three blocks later to another, some burn. Every other mint names its owner's last pass
    as predecessor; with claims, others name a pass of somebody. Owners hold what the first accounts of the ledger hold.
    """
    rows = T.history(s, d).select(F.col("block_height").alias("height"), F.col("id").cast("int").alias("n"), (F.col("inscription_id").cast("bigint") % OWNERS).alias("o"))
    name, owner = lambda n: F.concat(F.lit("p"), n.cast("string")), lambda o: F.concat(F.lit("o"), o.cast("string"))
    old = F.lag("n").over(Window.partitionBy("o").orderBy("height", "n"))
    named = F.when(F.col("n") % 2 == 0, F.col("_old"))
    named = F.when(F.col("n") % 4 == 3, F.col("n") - 30).otherwise(named) if claims else named
    rows = rows.withColumn("_old", old).withColumn("prev", F.when(named.isNotNull(), F.array(name(named))))
    kind = F.when(F.col("n") % 11 == 3, "invalid_mint").otherwise("mint")
    columns = ["height", "event_order", "op", "inscription_id", "owner", "prev", "satpoint", "balance", "delta"]
    nothing = {"prev": F.lit(None).cast("array<string>"), "satpoint": F.lit(None).cast("string"), "balance": F.lit(None).cast("bigint"), "delta": F.lit(None).cast("bigint"), "owner": F.lit(None).cast("string")}

    def made(df: DataFrame, **of) -> DataFrame:
        return df.select(*((nothing | of)[c].alias(c) for c in columns))

    n, h, own = F.col("n"), F.col("height"), owner(F.col("o"))
    mints = made(rows, height=h, event_order=n, op=kind, inscription_id=name(n), owner=own, prev=F.col("prev"), satpoint=F.concat(F.lit("s"), n.cast("string")))
    to = F.when(n % 5 == 1, owner(n * 3 % OWNERS)).otherwise(own)
    moved = made(rows.where("n % 5 in (1, 2)"), height=h + F.when(n % 5 == 1, 3).otherwise(1), event_order=n + MOVED, op=F.lit("transfer"), inscription_id=name(n), owner=to, satpoint=F.concat(F.lit("t"), n.cast("string")))
    burned = made(rows.where("n % 7 = 2"), height=h + 8, event_order=n + BURNED, op=F.lit("burn"), inscription_id=name(n))
    held = ledger.running_balance(ledger.deltas(ledger.signed_rows(T.outputs(s, d), T.spends(s, d)))).where(F.col("account").between(1, OWNERS))
    balances = made(held, height=h, event_order=F.lit(0), op=F.lit("balance"), inscription_id=F.lit(None).cast("string"), owner=owner(F.col("account") - 1), balance=F.col("balance"), delta=F.col("delta"))
    return mints.unionByName(moved).unionByName(burned).unionByName(balances)


def lifecycle(s: SparkSession, d: str, strict: bool = False) -> DataFrame:
    log = fsm.run(events(s, d, not strict), strict_terminal_energy=strict, strict_prev=strict)
    shown = "block_height inscription_id event_type prev_state new_state prev_owner new_owner new_satpoint".split()
    return log.select(*shown, F.col("energy").cast("bigint").alias("energy"))


def sql(strict: bool = False) -> str:
    """Places in the log are numbers here: height, rank and order in one."""
    at = lambda height, rank, order: f"((({height}) * 4 + {rank}) * 100000000 + {order})::BIGINT"
    claim = "" if strict else "WHEN n % 4 = 3 THEN n - 30 "
    spent = "0" if strict else "CASE WHEN f.taken < f.burnt THEN 0 ELSE f.kept END"
    valid = (
        """v AS (
  SELECT n, true AS valid FROM born WHERE may AND prev IS NULL
  UNION ALL SELECT c.heir, true FROM v JOIN claims c ON c.n = v.n
), sound AS (SELECT DISTINCT n FROM v)"""
        if strict
        else "sound AS (SELECT n FROM born WHERE may)"
    )
    return f"""WITH RECURSIVE {T.SQL_LEDGER}, {T.SQL_HISTORY}, mints AS (
  SELECT block_height AS h, id AS n, inscription_id::BIGINT % {OWNERS} AS o, lag(id) OVER (PARTITION BY inscription_id::BIGINT % {OWNERS} ORDER BY block_height, id) AS old FROM history
), moves AS (
  SELECT n, h + CASE WHEN n % 5 = 1 THEN 3 ELSE 1 END AS h, {at("h + CASE WHEN n % 5 = 1 THEN 3 ELSE 1 END", 1, f"n + {MOVED}")} AS pos, o AS minter, CASE WHEN n % 5 = 1 THEN n * 3 % {OWNERS} ELSE o END AS owner FROM mints WHERE n % 5 IN (1, 2)
), burns AS (
  SELECT n, h + 8 AS h, {at("h + 8", 1, f"n + {BURNED}")} AS pos FROM mints WHERE n % 7 = 2
), born AS (
  SELECT m.n, m.h, m.o, n % 11 <> 3 AS may, {at("m.h", "CASE WHEN n % 11 = 3 THEN 2 ELSE 1 END", "n")} AS born, CASE {claim}WHEN n % 2 = 0 THEN old END AS prev,
         (SELECT pos FROM burns b WHERE b.n = m.n) AS burnt FROM mints m
), claims AS (
  SELECT p.n, m.n AS heir, m.born AS pos FROM born m JOIN born p ON p.n = m.prev LEFT JOIN moves t ON t.n = p.n
  WHERE m.may AND p.may AND p.born < m.born AND (p.burnt IS NULL OR p.burnt > m.born) AND CASE WHEN t.pos < m.born THEN t.owner ELSE p.o END = m.o
), {valid}, firsts AS (
  SELECT c.n, min(c.pos) AS taken, arg_min(heir, c.pos) AS heir FROM claims c JOIN sound a ON a.n = c.n JOIN sound b ON b.n = c.heir GROUP BY c.n
), next AS (
  SELECT n, lead(born) OVER (PARTITION BY o ORDER BY born) AS remint FROM born JOIN sound USING (n)
), held AS (
  SELECT b.*, s.n IS NOT NULL AS valid, taken, heir, CASE WHEN s.n IS NOT NULL THEN nullif(least(coalesce(remint, 4611686018427387904), coalesce(burnt, 4611686018427387904), coalesce(t.pos, 4611686018427387904)), 4611686018427387904) END AS "end", remint
  FROM born b LEFT JOIN sound s USING (n) LEFT JOIN firsts USING (n) LEFT JOIN next USING (n) LEFT JOIN moves t ON t.n = b.n AND t.owner <> t.minter
), ended AS (
  SELECT *, "end" // 400000000 AS eh, CASE WHEN "end" = remint THEN 'remint' WHEN "end" = burnt THEN 'burn' WHEN "end" IS NOT NULL THEN 'away' END AS cause FROM held
), asked AS (
  SELECT e.n, x.h, x.pos FROM (SELECT n, h, pos FROM moves UNION ALL SELECT * FROM burns) x JOIN ended e ON e.n = x.n AND e.valid AND (e."end" IS NULL OR x.pos <= e."end")
), owned AS (
  SELECT account - 1 AS o, height AS h, balance, delta FROM ledger WHERE account BETWEEN 1 AND {OWNERS}
), steps AS (
  SELECT n, h, 0 AS kind, born AS pos, coalesce((SELECT arg_max(balance, w.h) FROM owned w WHERE w.o = e.o AND w.h <= e.h), 0) AS balance, 0 AS delta FROM ended e WHERE valid
  UNION ALL SELECT n, w.h, 1, born, w.balance, w.delta FROM owned w JOIN ended e ON w.o = e.o AND e.valid AND w.h > e.h AND w.h <= coalesce(e.eh, 1099511627776)
    WHERE delta <> 0 OR w.h = e.eh OR EXISTS (SELECT 1 FROM asked a WHERE a.n = e.n AND a.h = w.h)
  UNION ALL SELECT n, h, 2, pos, NULL, NULL FROM asked
  UNION ALL SELECT n, eh, 3, "end", NULL, NULL FROM ended WHERE cause <> 'burn'
), seen AS (
  SELECT *, last_value(CASE WHEN kind <= 1 THEN h END IGNORE NULLS) OVER w AS h0, last_value(balance IGNORE NULLS) OVER w AS b0
  FROM steps WINDOW w AS (PARTITION BY n ORDER BY h, kind, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), sized AS (
  SELECT *, CASE WHEN kind IN (0, 2) THEN 0 ELSE CASE WHEN b0 < 100000 THEN 0 ELSE b0::HUGEINT * 10000 * (h - h0) END - CASE WHEN coalesce(delta, 0) >= 0 THEN 0 ELSE (-delta)::HUGEINT * 43200000 END END AS st FROM seen
), sums AS (
  SELECT *, sum(st) OVER (PARTITION BY n ORDER BY h, kind, pos ROWS UNBOUNDED PRECEDING) AS sn FROM sized
), made AS (
  SELECT n, kind, pos, sn::HUGEINT AS sn, (sn - least(min(sn) OVER (PARTITION BY n ORDER BY h, kind, pos ROWS UNBOUNDED PRECEDING), 0))::HUGEINT AS low FROM sums
), r AS (
  SELECT n, 0::HUGEINT AS gained FROM ended WHERE valid AND n NOT IN (SELECT heir FROM ended WHERE heir IS NOT NULL)
  UNION ALL SELECT e.heir, greatest(r.gained + m.sn, m.low) FROM r JOIN ended e ON e.n = r.n AND e.heir IS NOT NULL JOIN made m ON m.n = r.n AND m.kind = 3
), f AS (
  SELECT e.*, gained, (SELECT greatest(gained + m.sn, m.low) FROM made m WHERE m.n = e.n AND m.pos = e."end" AND m.kind = CASE WHEN e.cause = 'burn' THEN 2 ELSE 3 END) AS kept FROM ended e LEFT JOIN r USING (n)
), x AS (
  SELECT n, h, pos, 'transfer' AS op, owner FROM moves UNION ALL SELECT n, h, pos, 'burn', NULL FROM burns
), c AS (
  SELECT x.*, f.valid, f.gained, f.kept, f.taken, f.burnt, f.o, coalesce(x.pos = f."end" AND f.cause = 'away', false) AS leaves, (SELECT t.owner FROM moves t WHERE t.n = x.n AND t.pos < x.pos) AS earlier, m.sn, m.low,
    CASE WHEN f.burnt < x.pos THEN 'burned' WHEN NOT f.valid THEN 'invalid' WHEN f.taken < x.pos THEN 'consumed' WHEN f."end" < x.pos OR (x.pos = f."end" AND f.cause = 'away') THEN 'dormant' ELSE 'active' END AS state
  FROM x JOIN f ON f.n = x.n LEFT JOIN made m ON m.n = x.n AND m.pos = x.pos AND m.kind = 2
), rows AS (
  SELECT h, n, CASE WHEN valid THEN 'mint' ELSE 'invalid_mint' END AS e, NULL AS s0, CASE WHEN valid THEN 'active' ELSE 'invalid' END AS s1, NULL AS o0, o AS o1, 's' || n AS sat, CASE WHEN valid THEN gained END AS energy FROM f
  UNION ALL SELECT "end" // 400000000, f.n, 'state_update', 'active', 'dormant', o, o, CASE WHEN t.pos < f."end" THEN 't' || f.n ELSE 's' || f.n END, kept FROM f LEFT JOIN moves t ON t.n = f.n WHERE cause = 'remint'
  UNION ALL SELECT taken // 400000000, f.n, 'state_update', 'dormant', 'consumed', CASE WHEN t.pos < taken THEN t.owner ELSE o END, CASE WHEN t.pos < taken THEN t.owner ELSE o END, CASE WHEN t.pos < taken THEN 't' || f.n ELSE 's' || f.n END, 0 FROM f LEFT JOIN moves t ON t.n = f.n WHERE heir IS NOT NULL
  UNION ALL SELECT h, n, 'state_update', 'active', 'dormant', o, o, 's' || n, kept FROM c WHERE leaves
  UNION ALL SELECT c.h, c.n, CASE WHEN op = 'burn' THEN 'state_update' WHEN c.owner = coalesce(earlier, o) THEN 'satpoint_update' ELSE 'owner_transfer' END, state, CASE WHEN op = 'burn' THEN 'burned' ELSE state END,
    coalesce(earlier, o), coalesce(owner, earlier, o), CASE WHEN op = 'transfer' OR earlier IS NOT NULL THEN 't' || c.n ELSE 's' || c.n END,
    CASE WHEN NOT valid THEN NULL WHEN state = 'burned' OR (op = 'burn' AND {str(strict).lower()}) THEN {spent.replace("f.", "c.")} WHEN state = 'consumed' THEN 0 WHEN state = 'active' THEN greatest(gained + sn, low) ELSE kept END FROM c
)
SELECT h AS block_height, 'p' || n AS inscription_id, e AS event_type, s0 AS prev_state, s1 AS new_state, 'o' || o0 AS prev_owner, 'o' || o1 AS new_owner, sat AS new_satpoint, energy::BIGINT AS energy FROM rows"""
