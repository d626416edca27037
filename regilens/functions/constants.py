"""Fixed domain values.

FIXED VALUES — these must equal the values used by the source analysis for
results to match. They are stated here once, in natural order, and every
operator takes them as overridable parameters.
"""

from __future__ import annotations

import datetime as _dt

# --- FIXED VALUES: event (transaction) types --------------------------------
LATE_PAYMENT = "Late Payment Penalty Fee"
PROMPT_PAYMENT = "Prompt Payment"

# --- FIXED VALUES: account type kept in the transaction fact ----------------
REGISTRATION_ACCOUNT = "Animal Registration"

# --- FIXED VALUES: discount LIKE pattern sets --------------------------------
# Set A: used by most discount queries (type list, flags, counts, rates, trends).
DISCOUNT_PATTERNS_A = ("%Fenced%", "%Neuter%", "%Obedience%", "%Permanent%")
# Set B: used by the combined suburb scorecard.
DISCOUNT_PATTERNS_B = ("%Fence%", "%Neut%", "%Obed%", "%Perm%")
# Set C: used by the discount date-range check.
DISCOUNT_PATTERNS_C = ("%Fenc%", "%Neut%", "%Obed%", "%Perm%")

# --- FIXED VALUES: label standardisation -------------------------------------
SUBURB_PREFIX_OLD = "RD "
SUBURB_PREFIX_NEW = "Rural Hamilton "
RURAL_PREFIX = "Rural Hamilton"
FEE_LABEL_RECODES = {
    "Probat. & Dangerous": "Probationary & Dangerous",
    "DisabilityAssistDog": "Disability Assist Dog",
}

# --- FIXED VALUES: key renames -----------------------------------------------
REGISTRATION_KEY = "Registration_Key"
REGISTRATION_KEY_RENAMES = {"Registration_ID": REGISTRATION_KEY}
TRANSACTION_KEY_RENAMES = {"Account_Number": REGISTRATION_KEY}

# --- FIXED VALUES: thresholds -------------------------------------------------
MIN_VALID_DATE = "2000-01-01"
AS_OF = _dt.date(2025, 1, 1)              # run date of the outlier checks, pinned so results are reproducible
TREND_MIN_YEAR = 2020
VALUE_LOW, VALUE_HIGH = 0, 500            # money outliers (amount, fee, value)
DISCOUNT_VALUE_LOW, DISCOUNT_VALUE_HIGH = -100, 100
RARE_GROUP_BELOW = 5
EXTREME_GROUP_LOW, EXTREME_GROUP_HIGH = 5, 2000
SEASON_FIRST_YEAR, SEASON_LAST_YEAR = 2020, 2024

# --- FIXED VALUES: audited column lists --------------------------------------
DOG_AUDIT_COLUMNS = (
    "Dog_Number", "Kept_At_Suburb", "Kept_At_Post_Code", "Kept_At_Town",
    "Active_Dog_Record",
)
REGISTRATION_AUDIT_COLUMNS = (
    "Dog_Number", "Registration_Key", "Registration_From", "Registration_To",
    "Effective_Date", "Calculated_Fee", "Fee_Code", "Fee_Code_Description",
    "Amount_Paid",
)
TRANSACTION_AUDIT_COLUMNS = (
    "Registration_Key", "Transaction_Date", "Transaction_Value", "Transaction_Type",
)

# --- FIXED VALUES: duplicate-inspection column lists -------------------------
DOG_DUPLICATE_ATTRS = (
    "Dog_Number", "Kept_At_Suburb", "Date_Of_Birth", "Animal_Sex",
    "Primary_Breed", "Primary_Colour", "Active_Dog_Record", "hash_binary",
)
REGISTRATION_DUPLICATE_ATTRS = (
    "Registration_Key", "Dog_Number", "Registration_From", "Registration_To",
    "Calculated_Fee", "hash_binary",
)
TRANSACTION_DUPLICATE_ATTRS = (
    "Registration_Key", "Transaction_Date", "Transaction_Value",
    "Transaction_Type", "hash_binary",
)

# every duplicate check of a table: check name -> its columns
DOG_DUPLICATE_CHECKS = {"fid": ("FID",), "hash": ("Dog_Number", "hash_binary"), "attributes": DOG_DUPLICATE_ATTRS}
REGISTRATION_DUPLICATE_CHECKS = {"fid": ("FID",), "hash": (REGISTRATION_KEY, "hash_binary"), "attributes": REGISTRATION_DUPLICATE_ATTRS}
TRANSACTION_DUPLICATE_CHECKS = {"fid": ("FID",), "hash": (REGISTRATION_KEY, "hash_binary"), "attributes": TRANSACTION_DUPLICATE_ATTRS}

# --- FIXED VALUES: inspection projections ------------------------------------
DOG_INSPECT_COLUMNS = (
    "Dog_Number", "Kept_At_Suburb", "Kept_At_Post_Code", "Kept_At_Town",
    "Active_Dog_Record",
)
REGISTRATION_INSPECT_COLUMNS = (
    "Dog_Number", "Registration_Key", "Registration_From", "Registration_To",
    "Effective_Date", "Calculated_Fee", "Fee_Code", "Fee_Code_Description",
    "Amount_Paid",
)
TRANSACTION_INSPECT_COLUMNS = (
    "Registration_Key", "Transaction_Date", "Transaction_Value", "Transaction_Type",
)
