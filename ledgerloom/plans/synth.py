"""A synthetic ledger with known truth, drawn from hashes: every row follows from the seed and its own number, so that
any number of tasks makes the same data."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import numbered_rows
from ..session import Scratch

#: Fixed values of the generator: shares of entity types, wallets per type, the covered time, mixes of scripts and ports.
TYPE_SHARES = {"exchange": 0.05, "ransomware": 0.02, "darknet": 0.03}
WALLET_WEIGHTS = {"licit": 1.0, "exchange": 50.0, "ransomware": 3.0, "darknet": 8.0, "mixer": 20.0}
BASE_US, DAYS, SPREAD_HOURS = 1_704_067_200_000_000, 90, 2.5
SCRIPTS = [("P2WPKH", 0.45), ("P2PKH", 0.35), ("P2SH", 0.12), ("P2WSH", 0.08)]
PORTS = [(8333, 0.90), (18333, 0.05), (28333, 0.05)]
FEES, CORRUPTED, SEED_SHARE = (0.00001, 0.0005), 0.005, (0.05, 0.10)
COUNTRIES = ["US", "DE", "NL", "SG", "JP", "GB", "FR", "CA", "BR", "KE"]
ILLICIT = ["ransomware", "darknet", "mixer"]
NETWORKS = 64


@dataclass(frozen=True)
class Config:
    seed: int = 42
    entities: int = 2_000
    wallets: int = 50_000
    transactions: int = 200_000
    ip_noise: float = 0.05
    break_rate: float = 0.1
    mixer_share: float = 0.02


class Draws:
    """Uniform numbers in [0, 1) by name and key."""

    def __init__(self, seed: int):
        self.seed = seed

    def u(self, name: str, *key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(name), *key), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def between(self, lo: float, hi: float, name: str, *key: Column) -> Column:
        return F.lit(lo) + F.lit(hi - lo) * self.u(name, *key)

    def whole(self, lo, hi, name: str, *key: Column) -> Column:
        """A whole number from lo to hi, both included."""
        lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
        return (lo + F.floor((hi - lo + 1) * self.u(name, *key))).cast("bigint")

    def normal(self, name: str, *key: Column) -> Column:
        return F.sqrt(-2 * F.log(1 - self.u(name + "/r", *key))) * F.cos(2 * F.pi() * self.u(name + "/a", *key))

    def lognormal(self, mu: float, sigma: float, name: str, *key: Column) -> Column:
        return F.exp(F.lit(mu) + F.lit(sigma) * self.normal(name, *key))

    def choice(self, weights: list[tuple], name: str, *key: Column) -> Column:
        u, upto, out = self.u(name, *key), 0.0, []
        for value, w in weights:
            upto += w
            out.append((value, upto))
        return reduce(lambda rest, x: F.when(u < x[1], F.lit(x[0])).otherwise(rest), reversed(out[:-1]), F.lit(out[-1][0]))


def networks(spark: SparkSession) -> DataFrame:
    """The 64 networks: octets, asn and country follow from the number."""
    i = F.col("id")
    country = F.element_at(F.array(*map(F.lit, COUNTRIES)), (i % len(COUNTRIES) + 1).cast("int"))
    return spark.range(NETWORKS).select(
        i.alias("net"),
        (20 + (7 * i) % 200).alias("octet1"),
        ((37 * i) % 256).alias("octet2"),
        (64512 + i).alias("asn"),
        country.alias("geo_country")
    )


def entities(spark: SparkSession, c: Config) -> DataFrame:
    """(i, entity_id, entity_type, home_net, home_third, peak_hour, lo, wallet_count); wallets lo .. lo + count - 1 are its own.

    Wallets are shared out by the type's weight, and what rounding leaves goes round one by one.
    """
    d, i = Draws(c.seed), F.col("id")
    kinds = [*TYPE_SHARES.items(), ("mixer", c.mixer_share)]
    e = spark.range(c.entities).select(
        i.alias("i"),
        F.format_string("entity_%05d", i).alias("entity_id"),
        d.choice([*kinds, ("licit", 1.0)], "type", i).alias("entity_type"),
        d.whole(0, NETWORKS - 1, "net", i).alias("home_net"),
        d.whole(0, 255, "third", i).alias("home_third"),
        d.whole(0, 23, "hour", i).alias("peak_hour")
    )
    weight = F.create_map(*(F.lit(x) for kv in WALLET_WEIGHTS.items() for x in kv))[F.col("entity_type")]
    total = e.agg(F.sum(weight).alias("total"))
    e = e.crossJoin(F.broadcast(total)).withColumn("base", F.floor(weight / F.col("total") * c.wallets).cast("bigint"))
    rest = e.agg((F.lit(c.wallets) - F.sum("base")).alias("rest"))
    e = e.crossJoin(F.broadcast(rest)).withColumn(
        "wallet_count", F.col("base") + F.floor(F.col("rest") / c.entities) + (F.col("i") < F.col("rest") % c.entities).cast("bigint")
    )
    upto = F.sum("wallet_count").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))  # as many rows as entities
    return e.withColumn("lo", F.coalesce(upto, F.lit(0))).drop("total", "base", "rest")


def wallet_name(number: Column) -> Column:
    return F.format_string("wallet_%06d", number.cast("bigint"))


def wallets(e: DataFrame) -> DataFrame:
    """(wallet_no, wallet_id, entity_id, entity_type)."""
    w = e.where("wallet_count > 0").select(
        "entity_id", "entity_type", F.explode(F.expr("sequence(lo, lo + wallet_count - 1)")).alias("wallet_no")
    )
    return w.select("wallet_no", wallet_name(F.col("wallet_no")).alias("wallet_id"), "entity_id", "entity_type")


def _network(df: DataFrame, c: Config, key: Column) -> DataFrame:
    """The home network, or with the chance of ip_noise any network, as src_ip, asn and geo_country; a peer as dst_ip."""
    d = Draws(c.seed)
    noisy = d.u("noise", key) < c.ip_noise
    net = F.when(noisy, d.whole(0, NETWORKS - 1, "noise-net", key)).otherwise(F.col("home_net"))
    third = F.when(noisy, d.whole(0, 255, "noise-third", key)).otherwise(F.col("home_third"))
    peer = d.whole(0, NETWORKS - 1, "peer", key)
    address = lambda n, t, last: F.concat_ws(".", 20 + (7 * n) % 200, (37 * n) % 256, t, last)
    country = F.element_at(F.array(*map(F.lit, COUNTRIES)), (F.col("_net") % len(COUNTRIES) + 1).cast("int"))
    hour = F.pmod(F.col("peak_hour") + SPREAD_HOURS * d.normal("hour", key), F.lit(24.0))
    at = F.lit(BASE_US) + ((d.u("day", key) * DAYS * 24 + hour + d.u("minute", key)) * 3_600_000_000).cast("bigint")
    return df.withColumn("_net", net).select(
        *df.columns,
        F.date_format(F.timestamp_micros(at), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        address(F.col("_net"), third, d.whole(1, 254, "last", key)).alias("src_ip"),
        address(peer, d.whole(0, 255, "peer-third", key), d.whole(1, 254, "peer-last", key)).alias("dst_ip"),
        d.whole(1024, 65535, "port", key).alias("src_port"),
        d.choice(PORTS, "dst-port", key).cast("bigint").alias("dst_port"),
        country.alias("geo_country"),
        (F.col("_net") + 64512).alias("asn"),
        d.choice(SCRIPTS, "script", key).alias("script_type"),
    )


_COLUMNS = [
    "txid",
    "timestamp",
    "src_ip",
    "dst_ip",
    "src_port",
    "dst_port",
    "geo_country",
    "asn",
    "input_addresses",
    "input_amounts",
    "output_addresses",
    "output_amounts",
    "fee",
    "script_type"
]


def _txid(c: Config, *label: Column) -> Column:
    return F.sha2(F.concat_ws("-", F.lit(str(c.seed)), *label), 256)


def baseline(spark: SparkSession, e: DataFrame, c: Config) -> DataFrame:
    """Ordinary payments: one or two inputs of the sender's wallet, one output or a payment and change."""
    d, i = Draws(c.seed), F.col("id")
    tx = spark.range(c.transactions).select(i.alias("n"), d.whole(0, c.wallets - 1, "sender", i).alias("wallet_no"))
    owner = wallets(e).select("wallet_no", "entity_id").join(e.select("entity_id", "home_net", "home_third", "peak_hour"), "entity_id")
    tx = _network(tx.join(owner, "wallet_no"), c, F.concat_ws("-", F.lit("tx"), "n"))
    n = F.col("n")
    amount, fee = d.lognormal(-2.0, 1.5, "amount", n), F.round(d.between(*FEES, "fee", n), 8)
    one_in, one_out = d.u("inputs", n) < 0.85, d.u("outputs", n) < 0.5
    split = lambda total, name: F.round(d.between(0.15, 0.85, name, n) * total, 8)
    me, to = wallet_name(F.col("wallet_no")), wallet_name(d.whole(0, c.wallets - 1, "to", n))
    tx = tx.withColumns({"txid": _txid(c, F.lit("tx"), n), "fee": fee, "_in": amount + fee, "_out": amount})
    parts = lambda one, total, name: F.when(one, F.array(F.round(total, 8))).otherwise(
        F.array(split(F.col(total), name), F.round(F.col(total) - split(F.col(total), name), 8))
    )
    return tx.withColumns(
        {
            "input_addresses": F.when(one_in, F.array(me)).otherwise(F.array(me, me)),
            "input_amounts": parts(one_in, "_in", "cut-in"),
            "output_addresses": F.when(one_out, F.array(to)).otherwise(F.array(to, me)),
            "output_amounts": parts(one_out, "_out", "cut-out")
        }
    ).select("n", *_COLUMNS)


def peeling(e: DataFrame, c: Config) -> DataFrame:
    """One chain per darknet entity that has two wallets: the rows, with pattern_id and hop."""
    d, i = Draws(c.seed), F.col("i")
    h = e.where("entity_type = 'darknet' and wallet_count >= 2").withColumns(
        {
            "hops": F.greatest(F.lit(1), F.least(d.whole(3, 8, "hops", i), F.col("wallet_count") - 1)),
            "decay": d.between(0.80, 0.95, "decay", i),
            "pot": d.lognormal(1.0, 1.0, "pot", i)
        }
    )
    h = h.withColumn("hop", F.explode(F.expr("sequence(0, hops - 1)")))
    key = F.concat_ws("-", F.lit("peel"), "i", "hop")
    value = lambda k: F.round(F.col("pot") * F.pow(F.col("decay"), k), 8)
    rows = _network(h, c, key)
    fee = F.round(d.between(*FEES, "fee", key), 8)
    onward, peel = value(F.col("hop") + 1), F.round(value(F.col("hop")) - value(F.col("hop") + 1) - fee, 8)
    noise = F.round(d.u("third-size", key) * 0.3 * peel, 8)
    broken = (d.u("third", key) < c.break_rate) & (noise > 0) & (noise < peel)
    target = lambda name: wallet_name(d.whole(0, c.wallets - 1, name, key))
    nxt = wallet_name(F.col("lo") + F.col("hop") + 1)
    return rows.select(
        F.format_string("peeling_%04d", "i").alias("pattern_id"),
        "hop",
        _txid(c, F.lit("peeling"), F.col("i"), F.col("hop")).alias("txid"),
        *_COLUMNS[1:8],
        F.array(wallet_name(F.col("lo") + F.col("hop"))).alias("input_addresses"),
        F.array(value(F.col("hop"))).alias("input_amounts"),
        F.when(broken, F.array(nxt, target("peel-to"), target("noise-to")))
        .otherwise(F.array(nxt, target("peel-to")))
        .alias("output_addresses"),
        F.when(broken, F.array(onward, F.round(peel - noise, 8), noise)).otherwise(F.array(onward, peel)).alias("output_amounts"),
        fee.alias("fee"),
        "script_type",
    )


def coinjoins(e: DataFrame, c: Config) -> DataFrame:
    """One round per mixer entity that has two wallets: equal inputs of its own, equal outputs to others."""
    d, i = Draws(c.seed), F.col("i")
    m = e.where("entity_type = 'mixer' and wallet_count >= 2").withColumn(
        "k", F.least(d.whole(3, 10, "participants", i), F.col("wallet_count")).cast("int")
    )
    rows = _network(m, c, F.concat_ws("-", F.lit("join"), "i"))
    coin, fee = F.round(d.lognormal(-1.5, 0.6, "coin", i), 8), F.round(d.between(*FEES, "fee", F.lit("join"), i) / F.col("k"), 8)
    broken = d.u("broken", i) < c.break_rate
    eps = F.round(d.between(0.00001, 0.05, "eps", i) * coin, 8)
    odd = F.floor(d.u("odd", i) * F.col("k"))
    outside = lambda j: wallet_name(
        F.pmod(
            F.col("lo") + F.col("wallet_count") + F.floor(d.u("recipient", i, j) * (c.wallets - F.col("wallet_count"))), F.lit(c.wallets)
        )
    )
    seq = F.expr("sequence(0, k - 1)")
    return rows.select(
        F.format_string("coinjoin_%04d", "i").alias("pattern_id"),
        _txid(c, F.lit("coinjoin"), i).alias("txid"),
        *_COLUMNS[1:8],
        F.transform(seq, lambda j: wallet_name(F.col("lo") + j)).alias("input_addresses"),
        F.transform(seq, lambda j: F.round(coin + fee, 8)).alias("input_amounts"),
        F.transform(seq, outside).alias("output_addresses"),
        F.transform(seq, lambda j: F.when(broken & (j == odd), F.round(coin - eps, 8)).otherwise(coin)).alias("output_amounts"),
        F.round(fee * F.col("k") + F.when(broken, eps).otherwise(0.0), 8).alias("fee"),
        "script_type",
    )


def ransoms(e: DataFrame, c: Config) -> DataFrame:
    """Collect from victims, pass on through own wallets, cash out at an exchange; one life cycle per ransomware entity."""
    d, i = Draws(c.seed), F.col("i")
    exchange = e.where("entity_type = 'exchange' and wallet_count > 0").select(
        F.row_number().over(Window.orderBy("i")).alias("x"), F.col("lo").alias("x_lo"), F.col("wallet_count").alias("x_count")
    )
    many = exchange.agg(F.count("*").alias("xs"))
    r = e.where("entity_type = 'ransomware' and wallet_count >= 2").crossJoin(F.broadcast(many)).where("xs > 0").withColumns(
        {
            "victims": d.whole(3, 8, "victims", i),
            "layers": F.least(F.lit(2), F.col("wallet_count") - 1),
            "x": (1 + F.floor(d.u("exchange", i) * F.col("xs"))).cast("int")
        }
    ).join(exchange, "x")
    ransom = lambda v: F.round(d.lognormal(-1.0, 0.8, "ransom", i, v), 8)
    r = r.withColumn("total", F.aggregate(F.expr("sequence(1, victims)"), F.lit(0.0), lambda s, v: s + ransom(v)))
    steps = r.withColumn("step", F.explode(F.expr("sequence(1, victims + layers + 1)")))
    key = F.concat_ws("-", F.lit("ransom"), "i", "step")
    fee = F.round(d.between(*FEES, "fee", key), 8)
    rows = _network(steps, c, key).withColumn("_f", fee)
    hop = F.col("step") - F.col("victims")  # 1 .. layers: passing on, layers + 1: cashing out
    collect = hop <= 0
    paid = F.aggregate(
        F.expr("sequence(1, greatest(step - victims, 1))"),
        F.lit(0.0),
        lambda s, k: s + F.round(d.between(*FEES, "fee", F.concat_ws("-", F.lit("ransom"), F.col("i"), F.col("victims") + k)), 8)
    )
    value = F.round(F.col("total") - paid, 8)
    before = F.round(value + F.col("_f"), 8)
    victim = wallet_name(
        F.pmod(
            F.col("lo") + F.col("wallet_count") + F.floor(d.u("victim", i, F.col("step")) * (c.wallets - F.col("wallet_count"))),
            F.lit(c.wallets)
        )
    )
    cash = wallet_name(F.col("x_lo") + F.floor(d.u("cash", i) * F.col("x_count")))
    label = F.when(collect, "collect").when(hop <= F.col("layers"), "layer").otherwise("cashout")
    return rows.select(
        _txid(c, F.lit("ransomware"), i, label, F.col("step")).alias("txid"),
        *_COLUMNS[1:8],
        F.array(F.when(collect, victim).otherwise(wallet_name(F.col("lo") + hop - 1))).alias("input_addresses"),
        F.array(F.when(collect, F.round(ransom(F.col("step")) + F.col("_f"), 8)).otherwise(before)).alias("input_amounts"),
        F.array(
            F.when(collect, wallet_name(F.col("lo"))).when(hop <= F.col("layers"), wallet_name(F.col("lo") + hop)).otherwise(cash)
        ).alias("output_addresses"),
        F.array(F.when(collect, ransom(F.col("step"))).otherwise(value)).alias("output_amounts"),
        F.col("_f").alias("fee"),
        "script_type",
    )


def corrupted(rows: DataFrame, c: Config, scratch: Scratch) -> DataFrame:
    """Exactly round(CORRUPTED * n) of the baseline rows spoilt, in the three ways in turn: a txid that is no hash, a negative
    output, an unreadable timestamp."""
    k = round(c.transactions * CORRUPTED)
    d = Draws(c.seed)
    slot = numbered_rows(
        rows.withColumn("_h", d.u("spoil", F.col("n"))), [F.col("_h"), F.col("n")], scratch, "slot", "spoil"
    ).withColumn("kind", F.when(F.col("slot") < k, F.col("slot") % 3))
    first = F.transform("output_amounts", lambda a, j: F.when(j == 0, -F.abs(a)).otherwise(a))
    return slot.withColumns(
        {
            "txid": F.when(F.col("kind") == 0, F.concat(F.lit("BADCHECKSUM_"), F.col("n").cast("string"))).otherwise(F.col("txid")),
            "output_amounts": F.when(F.col("kind") == 1, first).otherwise(F.col("output_amounts")),
            "timestamp": F.when(F.col("kind") == 2, "NOT-A-TIMESTAMP").otherwise(F.col("timestamp"))
        }
    ).select(*_COLUMNS)


def seed_wallets(w: DataFrame, c: Config) -> DataFrame:
    """(wallet_id): a twentieth to a tenth of the wallets of illicit entities, by hash."""
    share = SEED_SHARE[0] + (SEED_SHARE[1] - SEED_SHARE[0]) * ((c.seed * 2654435761) % 1000) / 1000
    bad = w.where(F.col("entity_type").isin(ILLICIT)).select("wallet_id")
    k = round(bad.count() * share)
    return bad.orderBy(F.xxhash64(F.lit(c.seed), "wallet_id"), "wallet_id").limit(k)


def generate(spark: SparkSession, c: Config) -> dict[str, DataFrame]:
    """raw (14 columns, the timestamp as text), entities (wallet_id, entity_id, entity_type), patterns and seeds."""
    scratch = Scratch(spark, "synth")
    e = scratch.write(entities(spark, c), "entities")
    peel, join = scratch.write(peeling(e, c), "peeling"), scratch.write(coinjoins(e, c), "coinjoins")
    raw = corrupted(
        baseline(spark, e, c), c, scratch
    ).unionByName(peel.select(*_COLUMNS)).unionByName(join.select(*_COLUMNS)).unionByName(ransoms(e, c).select(*_COLUMNS))
    sets = peel.withColumn("type", F.lit("peeling")).unionByName(
        join.withColumns({"hop": F.lit(0).cast("bigint"), "type": F.lit("coinjoin")})
    )
    patterns = sets.groupBy("pattern_id", "type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("hop", "txid"))), lambda x: x["txid"]).alias("txids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("input_addresses", "output_addresses"))))).alias("wallets")
    )
    w = wallets(e)
    return {
        "raw": scratch.write(raw, "raw"),
        "entities": w.select("wallet_id", "entity_id", "entity_type"),
        "patterns": patterns,
        "seeds": seed_wallets(w, c)
    }
