"""Declared columns of the core-banking tables. Text stays text (NULL, blank and 'N' differ)."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, MONEY, RATE, STAMP, WHOLE = T.StringType(), T.DecimalType(22, 3), T.DecimalType(38, 10), T.TimestampNTZType(), T.LongType()


def _table(text: str = "", money: str = "", stamp: str = "", whole: str = "", rate: str = "") -> T.StructType:
    kinds = ((text, TEXT), (money, MONEY), (rate, RATE), (stamp, STAMP), (whole, WHOLE))
    return T.StructType([T.StructField(n, t) for names, t in kinds for n in names.split()])


# --- fixed values: table and column names of the banking schema -----------------------------
SCHEMAS: dict[str, T.StructType] = {
    "sttm_customer": _table(
        text="""customer_no customer_name1 customer_type customer_category aml_required kyc_details
        kyc_ref_no frozen deceased whereabouts_unknown risk_profile country nationality
        exposure_country cust_classification cif_status auth_stat record_stat staff
        private_customer joint_venture crm_customer treasury_customer unique_id_value
        unique_id_name introducer credit_rating local_branch swift_code""",
        stamp="cif_creation_date",
    ),
    "sttm_cust_personal": _table(
        text="""customer_no p_national_id passport_no e_mail mobile_number telephone p_address1
        d_address1 sex minor resident_status birth_country place_of_birth d_country p_country
        pa_issued pa_holder_name pa_holder_nationalty us_res_status age_proof_submitted
        cust_comm_mode first_name last_name""",
        stamp="date_of_birth ppt_exp_date",
    ),
    "sttm_cust_account": _table(
        text="""cust_ac_no cust_no ccy account_class ac_stat_dormant ac_stat_frozen ac_stat_no_dr
        ac_stat_no_cr ac_stat_stop_pay ac_stat_block nsf_blacklist_status branch_code
        account_type mode_of_operation joint_ac_indicator salary_account auth_stat record_stat
        ac_desc""",
        money="""acy_curr_balance acy_today_tover_dr acy_today_tover_cr acy_mtd_tover_dr
        acy_mtd_tover_cr""",
        stamp="""overdraft_since ac_open_date date_last_cr_activity date_last_dr_activity
        dormancy_date""",
    ),
    "sttb_account": _table(
        text="""ac_gl_no branch_code cust_no pkey ac_stat_dormant ac_stat_frozen gl_stat_blocked
        ac_stat_no_dr ac_stat_no_cr ac_stat_stop_pay ac_or_gl gl_category auth_stat
        ac_gl_rec_status ac_gl_ccy gl_aclass_type""",
    ),
    "sttm_kyc_master": _table(
        text="""kyc_ref_no kyc_cust_type risk_level auth_stat record_stat maker_id checker_id
        kyc_desc""",
        stamp="maker_dt_stamp",
    ),
    "sttm_kyc_retail": _table(
        text="""kyc_ref_no pep resident acc_purpose us_res_status salary_income rental_income
        investment_income business_income prof_business_income overseas_income
        othr_income_sources nationality birth_country acc_type declared pa_given pep_remarks
        kyc_amts_ccy local_addr_country home_addr_country passport_no birth_place
        pa_holder_name""",
        money="total_income total_net_worth",
        stamp="visa_expiry_date passport_expiry_date kyc_nxt_review_date birth_date",
    ),
    "sttm_kyc_corporate": _table(
        text="""kyc_ref_no company_type funds_source parent_cmpny_country business_nature
        acc_purpose products_traded salary_mode acc_solicited compliance_clearance
        business_approval trade_licence_no introducer_dtl local_abroad_brn group_name
        kyc_amts_ccy""",
        money="annual_turnover",
        stamp="kyc_nxt_review_date audit_date",
        whole="employee_number",
    ),
    "sttm_kyc_corp_keypersons": _table(
        text="kyc_ref_no relationship nationality address_country tin", money="share_holding"
    ),
    "actb_history": _table(
        text="""trn_ref_no ac_no drcr_ind ac_ccy trn_code module product ac_branch type category
        cust_gl aml_exception user_id event related_account related_customer""",
        money="lcy_amount fcy_amount",
        rate="exch_rate",
        stamp="trn_dt",
    ),
    "sttm_account_class": _table(
        text="""account_class ac_class_type overdraft_facility cheque_book_facility atm_facility
        passbook_facility dormancy auth_stat description"""
    ),
    "sttm_customer_cat": _table(text="cust_cat cust_cat_desc auth_stat"),
    "cstm_function_userdef_fields": _table(
        text="function_id rec_key " + " ".join(f"field_val_{i}" for i in range(1, 32))
    ),
    "aaml_sir_details": _table(text="sir_status", stamp="sir_date close_date"),
}

# Partition column of a history stored by day; used for pruning when it is there.
DAY_COLUMN = "trn_day"

OPTIONAL_TABLES = frozenset({"aaml_sir_details"})

# Tables of the volume report, in report order.
VOLUME_TABLES = (
    "sttm_customer", "sttm_cust_personal", "sttm_cust_account", "sttb_account",
    "sttm_kyc_master", "sttm_kyc_retail", "sttm_kyc_corporate", "actb_history",
    "sttm_account_class", "sttm_customer_cat", "sttm_kyc_corp_keypersons",
    "cstm_function_userdef_fields",
)
