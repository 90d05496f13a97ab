"""Typed views over the entity-attribute-value table of user-defined fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlens.functions.expressions import key_segment, without_last_char
from tellerlens.operators.ranking import top_sample

# --- fixed values: per function, the key parts and the meaning of field 1, 2, … -------------
# A key part is (column, n-th segment); segment 0 is the key without its last character, and
# ("rec_key", None) keeps the raw key.
VIEWS: dict[str, tuple[list[tuple[str, int | None]], str]] = {
    "GEDCOLLT": (
        [("collateral_id", 1)],
        """coll_address coll_state collateral_status collateral_value_mgr_est collateral_value_omv
        collateral_value_fsv perfection_status valuers insurer od_creation_type od_facility_type
        collateral_owner crms_ref_no charge_type documentation_status perfection_status_new
        revaluation_date valuation_date valuer_name""",
    ),
    "GEDFACLT": ([("facility_id", 1)], "irr_value facility_collaterized"),
    "GEDMLIAB": ([("liability_no", 1)], "or_rating customer_credit_rating"),
    "GLDCHACC": ([("gl_code", 1)], "gl_ownership"),
    "SMDROLDF": ([("rec_key", None), ("role_id", 1)], "privilege_acclass_list privilege_role"),
    "SMDUSRDF": ([("rec_key", None), ("user_id", 1)], "email_address staff_id"),
    "STDACCLS": ([("rec_key", None), ("account_class", 1)], "privilege"),
    "STDBRANC": ([("branch_code", 1)], "branch_phone_no"),
    "STDCIF": (
        [("customer_no", 1)],
        """profession religion income_band second_nationality wedding_anniversary tax_id_number
        id_expiry_date customer_old_name customer_risk_rating id_required id_type id_number
        issuing_authority issuing_authority_np issue_date expiry_date revalidation_req
        compliance_watchlist compliance_watchlist_reason director_1_name director_2_name
        director_3_name director_4_name director_5_name alternative_email aml_cft_risk_rating
        broker_id aml_cft_risk_score mothers_maiden_name ins_relat sector_of_activity""",
    ),
    "STDCUSAC": (
        [("rec_key", None), ("account_no", 2)],
        """registration_number wedding_anniversary_date account_old_name card_required
        source_of_closure_request reason_for_closure mode_of_close_out_withdrawal
        branch_of_account_closure correlation_id customer_ibu ibu_status""",
    ),
    "STDKYCMN": (
        [("kyc_ref_no", 0)],
        """pep_status pep_status_others pep_office pep_relationship pep_relationship_others
        corp_ac_name_assoc_pep corp_ac_sign_or_director source_of_income_on_kyc_form""",
    ),
    "STDSTCHN": (
        [("rec_key", None), ("ac_no", 1), ("branch_code", 2), ("trans_date", 3)],
        "status_change_reason reason_pnd status_write_off_reason",
    ),
}
# --------------------------------------------------------------------------------------------


def udf_view(fields: DataFrame, function_id: str, *more: str | Column) -> DataFrame:
    """Rows of one function with decoded key and named fields. The function filter and the few
    fields in use reach the scan. ``more`` columns of the table come first."""
    keys, names = VIEWS[function_id]
    key = F.col("rec_key")
    parts = []
    for name, segment in keys:
        if segment is None:
            parts.append(key.alias(name))
        elif segment == 0:
            parts.append(without_last_char(key).alias(name))
        else:
            parts.append(key_segment(key, segment).alias(name))
    values = [F.col(f"field_val_{i}").alias(name) for i, name in enumerate(names.split(), 1)]
    return fields.filter(F.col("function_id") == function_id).select(*more, *parts, *values)


def udf_preview(fields: DataFrame, function_id: str, k: int = 5) -> DataFrame:
    """First ``k`` rows of one function in key order, decoded, one row per key part and field:
    (function_id, rank, rec_key, position, name, value)."""
    rows = fields.filter(F.col("function_id") == function_id)
    keys, names = VIEWS[function_id]
    used = [f"field_val_{i}" for i in range(1, len(names.split()) + 1)]
    first = top_sample(rows.select("function_id", "rec_key", *used), [F.col("rec_key").asc_nulls_last()], k)
    decoded = udf_view(first, function_id, "rank", F.col("rec_key").alias("_key"))
    named = [n for n, _ in keys] + names.split()
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), F.col(f"`{n}`").alias("value")) for i, n in enumerate(named, 1)])
    return decoded.select(F.lit(function_id).alias("function_id"), "rank", F.col("_key").alias("rec_key"), F.inline(cells))


def client_fields(fields: DataFrame) -> DataFrame:
    """Client rows under their exact key (client number plus separator), for left lookups."""
    return fields.filter(F.col("function_id") == "STDCIF").select(
        F.col("rec_key").alias("client_key"),
        F.col("field_val_1").alias("profession"),
        F.col("field_val_6").alias("tax_id"),
    )
