"""DM6 / DM7 / DM10: reference data changes and their cascades.

A batch of renames or removals becomes one old -> new mapping joined to
the inventory (broadcast only when the measured mapping is small: the
mapping has one row per renamed supplier / category).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.dates import ntz_lit
from tillpoint.functions.normalize import ascii_lower, js_trim, normalize_role, text_or_empty

# -- fixed values: messages -------------------------------------------------
MSG_SUPPLIER_REQUIRED = "Supplier name is required."
MSG_SUPPLIER_NOT_FOUND = "Supplier not found."
MSG_CATEGORY_REQUIRED = "Category name is required."
MSG_CATEGORY_NOT_FOUND = "Category not found."
MSG_CATEGORY_EXISTS = "Category name already exists."
MSG_NAME_REQUIRED = "Name is required."


MSG_SUPPLIER_EXISTS = "UNIQUE constraint failed: suppliers.supplier_name"
MSG_PROMO_EXISTS = "UNIQUE constraint failed: eload_promos.network_id, eload_promos.promo_name"
MSG_PROMO_NOT_FOUND = "Promo not found."


def _claimed(rows: DataFrame, keys: list[str], item: str, order: str, message: str) -> DataFrame:
    """Uniqueness inside a batch: the first valid row of a key takes it, and valid
    rows of other items with that key get ``message``."""
    first = (rows.where("error is null").groupBy(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)])
             .agg(F.min_by(item, order).alias("_taker")))
    on = [F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys)]
    joined = rows.join(first, on, "left")
    error = F.when(F.col("error").isNull() & ~F.col(item).eqNullSafe(F.col("_taker")), F.lit(message)).otherwise(F.col("error"))
    return joined.withColumn("error", error).drop("_taker", *[f"_c{i}" for i in range(len(keys))])


def _rename(renames: DataFrame, table: DataFrame, inventory: DataFrame, id_col: str, name_col: str, used_in: str,
            key, messages: tuple[str, str, str], extra: tuple[str, ...] = ()):
    """DM6 for suppliers and categories. ``renames``: the id, ``new_name``, an
    optional ``rename_id`` (their order) and optional ``extra`` columns.

    A new name must not be stored for another row (so a batch cannot swap names),
    and of several renames to one name the first takes it. Of a row's accepted
    renames the last stays. The inventory's mapping has one row per old name (the
    first accepted rename of that name moves its items), so no item is multiplied.
    """
    required, unknown, exists = messages
    order = F.col("rename_id") if "rename_id" in renames.columns else F.struct(id_col, "new_name")
    kept = [c for c in extra if c in renames.columns]
    r = renames.select(id_col, js_trim(text_or_empty(F.col("new_name"))).alias("new_name"), order.alias("_order"),
                       *[js_trim(text_or_empty(F.col(c))).alias(f"_x_{c}") for c in kept])
    stored = table.select(F.col(id_col).alias("_id"), F.col(name_col).alias("old_name"))
    holders = table.groupBy(key(F.col(name_col)).alias("_held")).agg(F.min(id_col).alias("_lo"), F.max(id_col).alias("_hi"))
    r = (r.join(stored, F.col(id_col) == F.col("_id"), "left").drop("_id").withColumn("_key", key(F.col("new_name")))
          .join(holders, F.col("_key") == F.col("_held"), "left"))
    error = (F.when(F.col("new_name") == "", F.lit(required)).when(F.col("old_name").isNull(), F.lit(unknown))
              .when((F.col("_lo") != F.col(id_col)) | (F.col("_hi") != F.col(id_col)), F.lit(exists)))
    r = _claimed(r.withColumn("error", error).drop("_held", "_lo", "_hi"), ["_key"], id_col, "_order", exists)
    ok = r.where("error is null")
    last = ok.groupBy(F.col(id_col).alias("_id")).agg(F.max_by(F.struct("new_name", *[f"_x_{c}" for c in kept]), "_order").alias("_new"))
    joined = table.join(last, F.col(id_col) == F.col("_id"), "left")
    changed = {name_col: F.coalesce("_new.new_name", name_col)} | {c: F.coalesce(f"_new._x_{c}", c) for c in kept}
    new_table = joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in table.columns])
    final = ok.join(last, F.col(id_col) == F.col("_id")).where("old_name != _new.new_name")
    mapping = final.groupBy(F.col("old_name").alias("_old")).agg(F.min_by("_new.new_name", "_order").alias("_to"))
    new_inventory = (inventory.join(mapping, inventory[used_in] == F.col("_old"), "left")
                     .withColumn(used_in, F.coalesce("_to", used_in)).select(inventory.columns))
    return new_table, new_inventory, r.where("error is not null").select(id_col, F.col("_order").alias("rename_id"), "error")


def rename_suppliers(renames: DataFrame, suppliers: DataFrame, inventory: DataFrame):
    """DM6: supplier edits -> ``(suppliers, inventory, rejects)``: name (unique,
    exactly), and contact number and address where given. Inventory rows that name
    the old supplier take the new name."""
    return _rename(renames, suppliers, inventory, "supplier_id", "supplier_name", "supplier", lambda c: c,
                   (MSG_SUPPLIER_REQUIRED, MSG_SUPPLIER_NOT_FOUND, MSG_SUPPLIER_EXISTS), ("contact_no", "address"))


def rename_categories(renames: DataFrame, categories: DataFrame, inventory: DataFrame):
    """DM6: category edits -> ``(categories, inventory, rejects)``; names stay unique
    ignoring ASCII case."""
    return _rename(renames, categories, inventory, "category_id", "category_name", "category", ascii_lower,
                   (MSG_CATEGORY_REQUIRED, MSG_CATEGORY_NOT_FOUND, MSG_CATEGORY_EXISTS))


def remove_suppliers(removed: DataFrame, suppliers: DataFrame, inventory: DataFrame):
    """DM7: delete suppliers; their inventory rows get a blank supplier."""
    gone = removed.select("supplier_id").join(suppliers, "supplier_id", "inner")
    names = gone.select(F.col("supplier_name").alias("_gone")).distinct()
    new_suppliers = suppliers.join(gone.select("supplier_id"), "supplier_id", "left_anti")
    new_inventory = (inventory.join(names, inventory.supplier == names._gone, "left")
                     .withColumn("supplier", F.when(F.col("_gone").isNotNull(), F.lit("")).otherwise(F.col("supplier")))
                     .drop("_gone"))
    return new_suppliers, new_inventory


def remove_networks(removed: DataFrame, promos: DataFrame) -> DataFrame:
    """DM7: deleting a network deletes its promos (ON DELETE CASCADE)."""
    return promos.join(removed.select("network_id"), "network_id", "left_anti")


def upsert_users(changes: DataFrame, users: DataFrame, devices: DataFrame, now: str):
    """DM10: ``changes(username, full_name, role, is_active, ts)``.

    Trimmed; the latest change per (trimmed, lower-cased) username wins (of
    changes at one time the greatest by its values); role via FN5; a blank full
    name is rejected; ``email`` and ``phone`` follow where both tables have them.
    Existing users are updated, new ones get ids after the maximum. Devices of the
    users that this batch makes inactive are revoked at ``now``. Returns ``(users,
    devices, rejects)``.
    """
    from tillpoint.operators.windows import global_row_number

    more = [x for x in ("email", "phone") if x in changes.columns and x in users.columns]
    fields = ["full_name", "role", "is_active", *more]
    c = changes.select(F.lower(js_trim(text_or_empty(F.col("username")))).alias("username"),
                       js_trim(text_or_empty(F.col("full_name"))).alias("full_name"),
                       normalize_role(F.col("role")).alias("role"),
                       F.coalesce(F.col("is_active").cast("int"), F.lit(1)).alias("is_active"),
                       *[js_trim(text_or_empty(F.col(x))).alias(x) for x in more], "ts")
    named = (F.col("full_name") != "") & (F.col("username") != "")
    rejects = c.filter(~named).select("username", "ts", F.lit(MSG_NAME_REQUIRED).alias("error"))
    value = F.struct(*fields)
    latest = c.filter(named).groupBy(F.col("username").alias("_key")).agg(F.max_by(value, F.struct("ts", value)).alias("_v"))
    joined = users.withColumn("_key", F.lower(F.col("username"))).join(latest, "_key", "full")
    kept = ["id", "username", *fields]
    existing = joined.filter(F.col("id").isNotNull()).select("id", "username", *[F.coalesce(f"_v.{f}", f).alias(f) for f in fields],
                                                             (F.col("_v.is_active") == 0).alias("_off"))
    fresh = joined.filter(F.col("id").isNull()).select(F.col("_key").alias("username"), "_v.*", (F.col("_v.is_active") == 0).alias("_off"))
    max_id = users.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = global_row_number(fresh, [F.col("username")], "_n").withColumn("id", max_id + F.col("_n")).drop("_n")
    every = existing.unionByName(fresh)
    new_users = every.select(kept)
    inactive = every.where("_off").select(F.col("id").alias("_uid"))
    stamp = ntz_lit(now)
    new_devices = (devices.join(inactive, devices.user_id == inactive._uid, "left")
                   .withColumn("revoked_at", F.when(F.col("_uid").isNotNull() & F.col("revoked_at").isNull(), stamp)
                               .otherwise(F.col("revoked_at"))).drop("_uid"))
    return new_users, new_devices, rejects


# -- fixed values: more messages ----------------------------------------------
MSG_NETWORK_REQUIRED = "Network name is required."
MSG_NETWORK_EXISTS = "Network already exists."
MSG_NETWORK_NOT_FOUND = "Network not found."
MSG_PROMO_REQUIRED = "Promo name is required."
MSG_PROMO_PRICE = "Selling price must be greater than zero."


def _new_ids(accepted: DataFrame, existing: DataFrame, id_col: str, order: list, out: str) -> DataFrame:
    from tillpoint.operators.windows import global_row_number
    max_id = existing.select(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    return global_row_number(accepted, order, "_n").withColumn(out, max_id + F.col("_n")).drop("_n")


def _unique_names(inputs: DataFrame, key, taken: DataFrame, exists_msg: str) -> DataFrame:
    """Error when the case-folded name is already stored, or was used by an
    earlier input of the same batch (inputs are applied in ``input_id`` order)."""
    from tillpoint.operators.windows import first_by_order
    keyed = inputs.withColumn("_k", key)
    firsts = first_by_order(keyed.filter(F.col("error").isNull()).select("input_id", "_k"), ["_k"],
                            [F.col("input_id")], "_first")
    return (keyed.join(taken.select(F.col("_k").alias("_taken")).distinct(), F.col("_k") == F.col("_taken"), "left")
                 .join(firsts.select("input_id", "_first"), "input_id", "left")
                 .withColumn("error", F.when(F.col("error").isNotNull(), F.col("error"))
                             .when(F.col("_taken").isNotNull() | ~F.coalesce(F.col("_first"), F.lit(True)),
                                   F.lit(exists_msg)))
                 .drop("_k", "_taken", "_first"))


def create_suppliers(inputs: DataFrame, suppliers: DataFrame):
    """DM10: ``inputs(input_id, supplier_name, contact_no, address)``; names
    are trimmed, required and unique (exactly). Like the other creates, returns
    ``(new_table, rejects(input_id, error), created(input_id, new_id))``."""
    c = inputs.select("input_id", *[js_trim(text_or_empty(F.col(x))).alias(x)
                                    for x in ("supplier_name", "contact_no", "address")])
    c = c.withColumn("error", F.when(F.col("supplier_name") == "", F.lit(MSG_SUPPLIER_REQUIRED)))
    c = _unique_names(c, F.col("supplier_name"), suppliers.select(F.col("supplier_name").alias("_k")), MSG_SUPPLIER_EXISTS)
    ok = _new_ids(c.filter(F.col("error").isNull()), suppliers, "supplier_id", [F.col("input_id")], "supplier_id")
    return (suppliers.unionByName(ok.select(*suppliers.columns)),
            c.filter(F.col("error").isNotNull()).select("input_id", "error"),
            ok.select("input_id", F.col("supplier_id").alias("new_id")))


def create_categories(inputs: DataFrame, categories: DataFrame):
    """DM10: ``inputs(input_id, category_name)``; unique ignoring case."""
    c = inputs.select("input_id", js_trim(text_or_empty(F.col("category_name"))).alias("category_name"))
    c = c.withColumn("error", F.when(F.col("category_name") == "", F.lit(MSG_CATEGORY_REQUIRED)))
    c = _unique_names(c, ascii_lower(F.col("category_name")),
                      categories.select(ascii_lower(F.col("category_name")).alias("_k")), MSG_CATEGORY_EXISTS)
    ok = _new_ids(c.filter(F.col("error").isNull()), categories, "category_id", [F.col("input_id")], "category_id")
    return (categories.unionByName(ok.select(*categories.columns)),
            c.filter(F.col("error").isNotNull()).select("input_id", "error"),
            ok.select("input_id", F.col("category_id").alias("new_id")))


def create_networks(inputs: DataFrame, networks: DataFrame):
    """DM10: ``inputs(input_id, network_name)``; upper-cased, unique ignoring case."""
    c = inputs.select("input_id", F.upper(js_trim(text_or_empty(F.col("network_name")))).alias("network_name"))
    c = c.withColumn("error", F.when(F.col("network_name") == "", F.lit(MSG_NETWORK_REQUIRED)))
    c = _unique_names(c, ascii_lower(F.col("network_name")),
                      networks.select(ascii_lower(F.col("network_name")).alias("_k")), MSG_NETWORK_EXISTS)
    ok = _new_ids(c.filter(F.col("error").isNull()), networks, "network_id", [F.col("input_id")], "network_id")
    return (networks.unionByName(ok.select(*networks.columns)),
            c.filter(F.col("error").isNotNull()).select("input_id", "error"),
            ok.select("input_id", F.col("network_id").alias("new_id")))


def _sellable(price):
    """A price above zero that the money type holds (NaN reads as NULL: refused)."""
    return F.coalesce((price > 0) & (price < 1e16), F.lit(False))


def create_promos(inputs: DataFrame, promos: DataFrame, networks: DataFrame):
    """DM10: ``inputs(input_id, network_id, promo_name, selling_price text)``:
    the network must exist, a name is required, the price must be > 0, and a
    network has a promo name once."""
    from tillpoint.jobs.imports import js_number
    nets = networks.select(F.col("network_id").alias("_nid"), "network_name")
    price = js_number(F.col("selling_price"))
    c = (inputs.join(nets, F.col("network_id") == F.col("_nid"), "left")
         .select("input_id", "network_id", "network_name",
                 js_trim(text_or_empty(F.col("promo_name"))).alias("promo_name"), price.alias("price"),
                 F.col("_nid").isNotNull().alias("_known")))
    c = c.withColumn("error", F.when(~F.col("_known"), F.lit(MSG_NETWORK_NOT_FOUND))
                     .when(F.col("promo_name") == "", F.lit(MSG_PROMO_REQUIRED))
                     .when(~_sellable(F.col("price")), F.lit(MSG_PROMO_PRICE))).drop("_known")
    c = _unique_names(c, F.struct("network_id", "promo_name"),
                      promos.select(F.struct(F.col("network_id").cast(c.schema["network_id"].dataType).alias("network_id"), "promo_name").alias("_k")),
                      MSG_PROMO_EXISTS)
    ok = _new_ids(c.filter(F.col("error").isNull()), promos, "promo_id", [F.col("input_id")], "promo_id")
    new = ok.select("network_id", "network_name", "promo_id", "promo_name",
                    F.col("price").cast("decimal(18,2)").alias("selling_price"))
    return (promos.unionByName(new.select(*promos.columns)),
            c.filter(F.col("error").isNotNull()).select("input_id", "error"),
            ok.select("input_id", F.col("promo_id").alias("new_id")))


def update_promos(changes: DataFrame, promos: DataFrame):
    """DM10: ``changes(change_id, promo_id, promo_name, selling_price text)`` ->
    ``(promos, rejects(change_id, error))``; the last accepted change of a promo
    stays, and a network keeps a promo name once (see :func:`_rename`)."""
    from tillpoint.jobs.imports import js_number
    c = changes.select("change_id", "promo_id", js_trim(text_or_empty(F.col("promo_name"))).alias("_name"),
                       js_number(F.col("selling_price")).alias("_price"))
    c = c.join(promos.select(F.col("promo_id").alias("_pid"), F.col("network_id").alias("_net")), F.col("promo_id") == F.col("_pid"), "left")
    held = promos.groupBy(F.col("network_id").alias("_hn"), F.col("promo_name").alias("_hp")).agg(F.min("promo_id").alias("_lo"), F.max("promo_id").alias("_hi"))
    c = c.join(held, (F.col("_net") == F.col("_hn")) & (F.col("_name") == F.col("_hp")), "left")
    c = c.withColumn("error", F.when(F.col("_pid").isNull(), F.lit(MSG_PROMO_NOT_FOUND)).when(F.col("_name") == "", F.lit(MSG_PROMO_REQUIRED))
                     .when(~_sellable(F.col("_price")), F.lit(MSG_PROMO_PRICE))
                     .when((F.col("_lo") != F.col("promo_id")) | (F.col("_hi") != F.col("promo_id")), F.lit(MSG_PROMO_EXISTS)))
    c = _claimed(c.drop("_pid", "_hn", "_hp", "_lo", "_hi"), ["_net", "_name"], "promo_id", "change_id", MSG_PROMO_EXISTS)
    last = c.where("error is null").groupBy(F.col("promo_id").alias("_pid")).agg(F.max_by(F.struct("_name", "_price"), "change_id").alias("_v"))
    out = promos.join(last, F.col("promo_id") == F.col("_pid"), "left").withColumns({
        "promo_name": F.coalesce("_v._name", "promo_name"),
        "selling_price": F.coalesce(F.col("_v._price").cast("decimal(18,2)"), F.col("selling_price"))})
    return out.select(promos.columns), c.where("error is not null").select("change_id", "error")


def remove_promos(removed: DataFrame, promos: DataFrame):
    """DM10: ``removed(promo_id)`` -> ``(promos, rejects(promo_id, error))``."""
    gone = removed.select("promo_id").distinct()
    return (promos.join(gone, "promo_id", "left_anti"),
            gone.join(promos.select("promo_id"), "promo_id", "left_anti").withColumn("error", F.lit(MSG_PROMO_NOT_FOUND)))


def update_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """DM10: the one-row settings table (names, alert flags) after ``changes(ts,
    <settings columns>)``: the latest change's non-NULL columns."""
    fields = [c for c in settings.columns if c in changes.columns and c != "id"]
    latest = changes.agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"_{c}") for c in fields])
    new = {c: F.coalesce(latest.select(f"_{c}").scalar(), F.col(c)) for c in fields}
    return settings.select(*[new[c].alias(c) if c in new else F.col(c) for c in settings.columns])
