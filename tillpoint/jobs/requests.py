"""DM4 / DM5: creating digital requests and moving them through their states.

Transitions: Pending -> Completed or Failed; terminal states refuse any
further command. Per request, commands are taken in time order. Before
the first accepted command the request is Pending, so a command's
validity depends only on the stored row: the first accepted command is
the earliest command valid against the stored row (a grouped ``min_by``).
Later commands see the terminal state and are refused with its message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint import params as P
from tillpoint.functions.normalize import js_trim, name_or_system, normalize_service_type, padded_code, text_or_empty
from tillpoint.functions.text import ph_mobile
from tillpoint.jobs.imports import js_number
from tillpoint.operators.windows import global_row_number

# -- fixed values: messages -------------------------------------------------
MSG_MOBILE = "Enter a valid 11-digit mobile number starting with 09."
MSG_GCASH_AMOUNT = "Enter a valid GCash amount."
MSG_NETWORK = "Choose a network for the eload request."
MSG_LOAD = "Choose a load option for the eload request."
MSG_ELOAD_AMOUNT = "Enter a valid eload amount."
MSG_AMOUNT = "Amount must be greater than zero."
MSG_NOT_FOUND = "Request not found."
MSG_ALREADY_COMPLETED = "This request is already completed."
MSG_WAS_FAILED = "This request was marked as failed."
MSG_NEEDS_REFERENCE = "GCash completion requires a reference number."
MSG_COMPLETED_CANNOT_FAIL = "Completed requests cannot be marked as failed."
MSG_ALREADY_FAILED = "This request is already marked as failed."
MSG_REASON = "Failure reason is required."


def create_requests(inputs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DM4: ``inputs`` has ``input_id, service_type, mobile_number, amount
    (text), cash_flow, reference_number, network, load_type, load_value,
    notes, requested_by_name``. Returns ``(new_requests, rejects)``."""
    svc = normalize_service_type(F.col("service_type"))
    mobile = ph_mobile(F.col("mobile_number"))
    amount = js_number(F.col("amount"))
    # NaN (NULL here) and amounts the money type cannot hold, Infinity included,
    # have no row to be stored in
    stored = F.coalesce((amount > 0) & (amount < 1e16), F.lit(False))
    network = F.upper(js_trim(text_or_empty(F.col("network"))))
    load_value = js_trim(text_or_empty(F.col("load_value")))
    error = (F.when(mobile == "", F.lit(MSG_MOBILE))
              .when((svc == "gcash") & amount.isNotNull() & (amount <= 0), F.lit(MSG_GCASH_AMOUNT))
              .when((svc == "eload") & (network == ""), F.lit(MSG_NETWORK))
              .when((svc == "eload") & (load_value == ""), F.lit(MSG_LOAD))
              .when((svc == "eload") & amount.isNotNull() & (amount <= 0), F.lit(MSG_ELOAD_AMOUNT))
              .when(~stored, F.lit(MSG_AMOUNT)))
    checked = inputs.withColumn("error", error)
    rejects = checked.filter(F.col("error").isNotNull()).select("input_id", "error")
    ok = checked.filter(F.col("error").isNull())
    max_id = requests.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = global_row_number(ok, [F.col("input_id")], "_n").withColumn("id", max_id + F.col("_n"))
    kind = js_trim(text_or_empty(F.col("cash_flow")))
    is_gcash = svc == "gcash"
    new = numbered.select(
        "id", F.when(is_gcash, padded_code("GC", F.col("id"))).otherwise(padded_code("EL", F.col("id"))).alias("request_code"),
        svc.alias("service_type"), F.lit(P.PENDING).alias("status"), mobile.alias("mobile_number"),
        amount.cast("decimal(18,2)").alias("amount"),
        F.when(is_gcash, F.when(kind == "", F.lit("Cash In")).otherwise(kind)).otherwise(F.lit("")).alias("request_kind"),
        F.when(is_gcash, F.lit("")).otherwise(network).alias("network"),
        F.when(is_gcash, F.lit("")).otherwise(F.lower(js_trim(text_or_empty(F.col("load_type"))))).alias("load_type"),
        F.when(is_gcash, F.lit("")).otherwise(load_value).alias("load_value"),
        F.when(is_gcash, js_trim(text_or_empty(F.col("reference_number")))).otherwise(F.lit("")).alias("reference_no"),
        js_trim(text_or_empty(F.col("notes"))).alias("notes"),
        name_or_system(F.col("requested_by_name")).alias("requested_by_name"), "input_id")
    return new, rejects


def _verdict_against(status, service, stored_ref, action, ref, reason):
    """Message for a command against a row in ``status`` (NULL = accepted)."""
    given_ref = js_trim(text_or_empty(ref))
    effective_ref = F.when(given_ref != "", given_ref).otherwise(js_trim(text_or_empty(stored_ref)))
    complete = (F.when(status == P.COMPLETED, F.lit(MSG_ALREADY_COMPLETED))
                 .when(status == P.FAILED, F.lit(MSG_WAS_FAILED))
                 .when((F.lower(service) == "gcash") & (effective_ref == ""), F.lit(MSG_NEEDS_REFERENCE)))
    fail = (F.when(status == P.COMPLETED, F.lit(MSG_COMPLETED_CANNOT_FAIL))
             .when(status == P.FAILED, F.lit(MSG_ALREADY_FAILED))
             .when(js_trim(text_or_empty(reason)) == "", F.lit(MSG_REASON)))
    return F.when(action == "complete", complete).otherwise(fail), effective_ref


def apply_transitions(requests: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DM5: ``commands`` has ``command_id, request_id, action ('complete' |
    'fail'), ts, reference_no, reason, by_name``. Returns ``(new_requests,
    outcomes(command_id, request_id, outcome))`` where outcome is
    ``applied`` or the refusal message."""
    stored = requests.select(F.col("id").alias("request_id"), F.col("status").alias("s_status"),
                             F.col("service_type").alias("s_service"), F.col("reference_no").alias("s_ref"))
    c = commands.join(stored, "request_id", "left")
    msg0, eff_ref = _verdict_against(F.col("s_status"), F.col("s_service"), F.col("s_ref"),
                                     F.col("action"), F.col("reference_no"), F.col("reason"))
    c = c.withColumn("_msg0", F.when(F.col("s_status").isNull(), F.lit(MSG_NOT_FOUND)).otherwise(msg0)) \
         .withColumn("_eff_ref", eff_ref)
    order = F.struct("ts", "command_id")
    winners = (c.filter(F.col("_msg0").isNull()).groupBy("request_id")
               .agg(F.min_by(F.struct("command_id", "action", "ts", "_eff_ref", "reason", "by_name"), order).alias("w")))
    c = c.join(winners, "request_id", "left")
    after = F.col("w").isNotNull() & (F.struct("ts", "command_id") > F.struct(F.col("w.ts"), F.col("w.command_id")))
    new_status = F.when(F.col("w.action") == "complete", F.lit(P.COMPLETED)).otherwise(F.lit(P.FAILED))
    msg_after, _ = _verdict_against(new_status, F.col("s_service"), F.col("s_ref"), F.col("action"),
                                    F.col("reference_no"), F.col("reason"))
    outcome = (F.when(F.col("w.command_id") == F.col("command_id"), F.lit("applied"))
                .when(after, msg_after).otherwise(F.col("_msg0")))
    outcomes = c.select("command_id", "request_id", outcome.alias("outcome"))

    w = winners.select("request_id", "w")
    r = requests.join(w, requests.id == w.request_id, "left")
    done = F.col("w.action") == "complete"
    failed = F.col("w.action") == "fail"
    by = name_or_system(F.col("w.by_name"))
    stored_failer = F.col("failed_by_name") if "failed_by_name" in requests.columns else F.lit("")
    new_requests = r.select(
        *[F.col(x) for x in requests.columns if x not in (
            "status", "reference_no", "completed_by_name", "completed_at", "failed_reason", "failed_by_name", "failed_at")],
        F.when(done, F.lit(P.COMPLETED)).when(failed, F.lit(P.FAILED)).otherwise(F.col("status")).alias("status"),
        F.when(done, F.col("w._eff_ref")).otherwise(F.col("reference_no")).alias("reference_no"),
        F.when(done, by).otherwise(F.col("completed_by_name")).alias("completed_by_name"),
        F.when(done, F.col("w.ts")).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(failed, js_trim(F.col("w.reason"))).otherwise(F.col("failed_reason")).alias("failed_reason"),
        F.when(failed, by).otherwise(stored_failer).alias("failed_by_name"),
        F.when(failed, F.col("w.ts")).otherwise(F.col("failed_at")).alias("failed_at"))
    return new_requests, outcomes

