"""Column names shared by all operators."""

MEMBER = "member_id_hash"
DATE = "date_of_service"
INDEX = "index_date"
CLAIM_ID = "claim_entry_id"
ICD = "icd_code"
CLAIM_TYPE = "claim_type"
PROC = "proc_code"
DRUG = "product_service_name"
COHORT = "cohort"
ENROLL_START = "date_of_enrollment"
ENROLL_END = "termination_date"
