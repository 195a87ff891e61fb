"""Column sets of the stored tables. Raw layer: all strings under the export headers; typed layer: snake names."""

from __future__ import annotations

from pyspark.sql import types as T

# Export header -> typed column, in file order.
CHARGE_HEADERS = {
    "Date Of Service": "service_date",
    "Rendering Provider": "provider_raw",
    "Service Charge Amount": "charge_amount",
    "Pri Ins Insurance Contract Adjustment": "pri_adjustment",
    "Sec Ins Insurance Contract Adjustment": "sec_adjustment",
    "Other Ins Insurance Contract Adjustment": "oth_adjustment",
    "Pri Ins Insurance Payment": "pri_payment",
    "Sec Ins Insurance Payment": "sec_payment",
    "Other Ins Insurance Payment": "oth_payment",
    "Pat Payment Amount": "pat_payment",
    "Other Adjustment": "other_adjustment",
    "Procedure Code": "procedure_code",
    "Procedure Codes with Modifiers": "code_text",
    "Encounter ID": "encounter_id",
    "Patient ID": "patient_id",
    "Encounter Procedure ID": "epid",
}
CHARGE_MONEY = (
    "charge_amount", "pri_adjustment", "sec_adjustment", "oth_adjustment",
    "pri_payment", "sec_payment", "oth_payment", "pat_payment", "other_adjustment",
)
CHARGE_TEXT = ("provider_raw", "procedure_code", "code_text", "encounter_id", "patient_id", "epid")

# Exam sheet header -> typed column, and the cell position of each.
EXAM_HEADERS = {
    "Case ID": "case_id",
    "Provider": "provider_raw",
    "Date of Service": "service_date",
    "Focused DBQs": "focused",
    "Routine IMOs": "opinions",
    "TBI": "tbi",
    "Gen Med DBQs": "genmed",
    "No Show": "no_show",
}
EXAM_POSITIONS = {
    "Case ID": 0, "Provider": 1, "Date of Service": 3, "Focused DBQs": 4,
    "Routine IMOs": 5, "TBI": 6, "Gen Med DBQs": 7, "No Show": 15,
}
BANK_HEADERS = {"Date": "entry_date", "Amount": "amount", "Running Bal.": "running_balance"}

# Element of a charge record -> export header.
CHARGE_ELEMENTS = {
    "ServiceStartDate": "Date Of Service",
    "RenderingProviderName": "Rendering Provider",
    "TotalCharges": "Service Charge Amount",
    "PrimaryInsuranceInsuranceContractAdjustment": "Pri Ins Insurance Contract Adjustment",
    "SecondaryInsuranceInsuranceContractAdjustment": "Sec Ins Insurance Contract Adjustment",
    "TertiaryInsuranceInsuranceContractAdjustment": "Other Ins Insurance Contract Adjustment",
    "PrimaryInsuranceInsurancePayment": "Pri Ins Insurance Payment",
    "SecondaryInsuranceInsurancePayment": "Sec Ins Insurance Payment",
    "TertiaryInsuranceInsurancePayment": "Other Ins Insurance Payment",
    "PatientPaymentAmount": "Pat Payment Amount",
    "OtherAdjustment": "Other Adjustment",
    "ProcedureCode": "Procedure Code",
    "EncounterID": "Encounter ID",
    "PatientID": "Patient ID",
    "EncounterProcedureID": "Encounter Procedure ID",
}
MODIFIER_ELEMENTS = ("ProcedureModifier1", "ProcedureModifier2", "ProcedureModifier3", "ProcedureModifier4")


def all_strings(names) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def _typed(names, money=()) -> T.StructType:
    kinds = {"service_date": T.DateType()} | {name: T.DecimalType(18, 2) for name in money}
    return T.StructType([T.StructField(name, kinds.get(name, T.StringType())) for name in names])


TYPED_CHARGES = _typed(CHARGE_HEADERS.values(), CHARGE_MONEY)
STORED_EXAMS = T.StructType([
    *_typed([*EXAM_HEADERS.values(), "patient_id"]).fields, T.StructField("exam_revenue", T.DecimalType(18, 2)),
    T.StructField("is_no_show", T.BooleanType()), T.StructField("week", T.DateType())])
RAW_CHARGES = all_strings(CHARGE_HEADERS)
RAW_EXAMS = all_strings(EXAM_HEADERS)
RAW_BANK = all_strings(BANK_HEADERS)
CHARGE_RECORD = all_strings([*CHARGE_ELEMENTS, *MODIFIER_ELEMENTS])
APPOINTMENT_RECORD = all_strings(["StartDate", "EndDate", "ConfirmationStatus"])
REASON_RECORD = all_strings(["ID", "Name", "Duration"])

AUDIT = T.StructType([
    T.StructField("sync_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("records_fetched", T.LongType()),
    T.StructField("records_new", T.LongType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("last_sync_date", T.DateType()),
    T.StructField("records_rejected", T.LongType()),
])

REVIEW = T.StructType([
    T.StructField("author_name", T.StringType()),
    T.StructField("author_url", T.StringType()),
    T.StructField("profile_photo_url", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("time", T.LongType()),
    T.StructField("relative_time_description", T.StringType()),
])
REVIEW_PAYLOAD = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("result", T.StructType([T.StructField("reviews", T.ArrayType(REVIEW))])),
])
