"""SC6 / JN6 / NE3: the eLoad network and promo catalogue.

The default catalogue is a fixed literal (24 promos); prices come from the
promo name (FN9). Join strategies are left to AQE. ``catalog_flat`` (network,
promo rows) is the form for catalogues of any size; ``catalog_map`` is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.functions.normalize import ascii_lower
from tillpoint.functions.text import last_number

# -- fixed values: default eLoad networks and their promos, in seed order ----
DEFAULT_NETWORKS = {
    "TM": ["EZ50", "ASTIG99", "ALLNET20", "EASYSURF50"],
    "GLOBE": ["GO59", "GO+99", "GOUNLI129", "SURF4ALL99"],
    "SMART": ["ALL DATA 50", "MAGICSARAP99", "POWER ALL 99", "GIGA VIDEO 99"],
    "TNT": ["TNT PANALO 30", "SURFSAYA 50", "ALL DATA 99", "SAYA ALL 99"],
    "SUN": ["CTC50", "TU200", "SURF50", "UNLI TXT 50"],
    "DITO": ["DITO 10", "DITO 50", "LEVEL-UP 99", "UNLI 5G 149"],
}


def default_promos(spark: SparkSession) -> DataFrame:
    """The seeded catalogue: network_id, network_name, promo_id, promo_name,
    selling_price (the last number in the name)."""
    rows = []
    promo_id = 0
    for network_id, (network, promos) in enumerate(DEFAULT_NETWORKS.items(), start=1):
        for promo in promos:
            promo_id += 1
            rows.append((network_id, network, promo_id, promo))
    df = spark.createDataFrame(rows, "network_id int, network_name string, promo_id int, promo_name string")
    return df.withColumn("selling_price", last_number(F.col("promo_name")).cast("decimal(18,2)"))


def networks_in_use(requests: DataFrame) -> DataFrame:
    """Networks named by eLoad requests (upper-cased, as the reference stores
    them), with their request counts."""
    e = requests.filter(F.col("service_type") == "eload")
    return (e.groupBy(F.upper(F.trim(F.col("network"))).alias("network_name"))
            .agg(F.count(F.lit(1)).alias("requests")))


def catalog_flat(requests: DataFrame, promos: DataFrame) -> DataFrame:
    """JN6 flattened: each network in use with each of its promos; a network
    without promos is kept with NULL promo columns."""
    nets = networks_in_use(requests)
    p = promos.select("network_name", "promo_id", "promo_name", "selling_price")
    return nets.join(p, "network_name", "left").orderBy(*catalog_order())


def catalog_order():
    """SO2: networks and their promos by NOCASE name, then id."""
    return [ascii_lower(F.col("network_name")), ascii_lower(F.col("promo_name")), F.col("promo_id")]


def catalog_nested(requests: DataFrame, promos: DataFrame) -> DataFrame:
    """NE3: one row per network with its ``promos`` array (NOCASE name order),
    kept as ``[]`` when it has none."""
    flat = catalog_flat(requests, promos)
    promo = F.struct(ascii_lower(F.col("promo_name")).alias("sort_name"), "promo_id", "promo_name", "selling_price")
    grouped = flat.groupBy("network_name", "requests").agg(
        F.array_sort(F.collect_list(F.when(F.col("promo_id").isNotNull(), promo))).alias("promos"))
    return grouped.select("network_name", "requests",
                          F.transform("promos", lambda p: F.struct(p["promo_id"].alias("promo_id"),
                                                                   p["promo_name"].alias("name"),
                                                                   p["selling_price"].alias("price"))).alias("promos")
                          ).orderBy(ascii_lower(F.col("network_name")))


def catalog_map(requests: DataFrame, promos: DataFrame) -> DataFrame:
    """NE3 dictionary form: one row holding ``map<network, array<promo>>``.
    Its size is the catalogue's (networks x promos), not the data's."""
    nested = catalog_nested(requests, promos)
    return nested.agg(F.map_from_entries(F.collect_list(F.struct("network_name", "promos"))).alias("catalog"))
