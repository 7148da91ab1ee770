"""Six sample cases and the results they must give."""

IRFAN = {"full_name": "Mohammed Irfan Shaikh", "father_name": "Abdul Rahim Shaikh", "dob": "14/06/1992"}
KURLA = "H No 42, Gandhi Nagar, Kurla West, Mumbai, Maharashtra 400070"
NEW_HOME = "Plot No 30, Sai Srushti, Laxmi Nagar, Stugirni Chowk, Aurangabad, Maharashtra 431001"
OLD_HOME = "Flat 12, CIDCO N-4, Aurangabad 431003"
SANIKA = {"full_name": "Sanika Chavan", "father_name": "Santosh Chavan", "dob": "15/08/2001"}

BASE_DOCS = [
    ("Aadhaar Card", {**IRFAN, "address": KURLA, "id_number": "4821 6634 9012"}),
    ("PAN Card", {"full_name": "Mohd Irfan Shaikh", "father_name": "Abdul Rahim Sheikh", "dob": "14-06-1992",
                  "address": "UNCERTAIN", "id_number": "BXQPS4821K"}),
    ("Bank Passbook", {"full_name": "Mohammed Irfan Shaik", "father_name": "Abdul Rahim Shaikh", "dob": "UNCERTAIN",
                       "address": "42 Gandhi Nagar, Kurla (W), Mumbai 400070", "id_number": "XXXXXX78421"}),
]
RTO_DOCS = [
    ("Driving License", {**IRFAN, "address": "H No 12, Andheri East, Mumbai 400069", "id_number": "MH02 20110012345"}),
    ("Aadhaar Card", {**IRFAN, "address": KURLA, "id_number": "4821 6634 9012"}),
]
SCHEME_DOCS = [
    ("Aadhaar Card", {**IRFAN, "address": KURLA, "id_number": "4821 6634 9012"}),
    ("Ration Card", {"full_name": "Mohamad Irfan Shaikh", "father_name": "A R Shaikh", "dob": "UNCERTAIN",
                     "address": "House 42, Gandhi Nagar, Kurla Paschim, Mumbai 400070", "id_number": "MH-RC-2201-88431"}),
]
SANIKA_DOCS = [
    ("Aadhaar Card", {**SANIKA, "address": NEW_HOME, "id_number": "4821 6634 9012"}),
    ("PAN Card", {**SANIKA, "address": "UNCERTAIN", "id_number": "ABCPS1234C"}),
    ("Bank Passbook", {**SANIKA, "dob": "UNCERTAIN", "address": "Plot No 30, Sai Srushti, Laxmi Nagar, Aurangabad 431001",
                       "id_number": "XXXXXX39101"}),
    ("Driving License", {**SANIKA, "full_name": "Sanika Santosh Chavan", "dob": "15-08-2001", "address": OLD_HOME,
                         "id_number": "MH20 20190045678"}),
    ("Scanned Application Form", {**SANIKA, "address": NEW_HOME, "id_number": "MH20 20190045678"}),
]
HOUSE = "House 42, Gandhi Nagar, Kurla West, Mumbai 400070"
FORMS = {
    "sanika": {**SANIKA, "dl_number": "MH20 20190045678", "pan_number": "ABCPS1234C", "aadhaar_number": "4821 6634 9012",
               "mobile": "7887403910", "email": "sanika.chavan@email.com", "change_type": "Address", "old_address": OLD_HOME,
               "new_address": NEW_HOME, "category": "General"},
    "mobile": {**IRFAN, "aadhaar_number": "4821 6634 9012", "mobile": "98765 43210", "address": HOUSE},
    "rto": {"full_name": IRFAN["full_name"], "dl_number": "MH02 20110012345", "dob": "14/06/1992", "mobile": "98765 43210",
            "change_type": "Address", "old_address": "H No 12, Andheri East, Mumbai 400069", "new_address": HOUSE},
    "scheme": {"full_name": IRFAN["full_name"], "aadhaar_number": "4821 6634 9012", "dob": "14/06/1992", "mobile": "98765 43210",
               "address": HOUSE, "scheme_name": "e-Shram registration", "category": "OBC", "annual_income": "180000"},
    "pan": {"full_name": "Mohd Irfan Shaikh", "pan_number": "BXQPS4821K", "aadhaar_number": "4821 6634 9012",
            "dob": "14/06/1992", "mobile": "98765 43210"},
    "complaint": {"full_name": IRFAN["full_name"], "mobile": "98765 43210", "aadhaar_number": "4821 6634 9012",
                  "department": "UIDAI / Aadhaar Seva Kendra", "complaint_summary": "Mobile link pending after 12 days",
                  "desired_outcome": "Complete mobile linking"},
}
# case: (service, form, documents, (match, variant, critical), blockers, primary, score, grade, per document %, case %)
CASES = [
    ("rto_dl_update", "sanika", SANIKA_DOCS, (10, 6, 2), {"Driving License": 2}, "Driving License", 100.0, "READY",
     [("Aadhaar Card", 94), ("PAN Card", 98), ("Bank Passbook", 90), ("Driving License", 86)], 92),
    ("link_mobile_aadhaar", "mobile", BASE_DOCS, (1, 7, 0), {}, None, 97.0, "FIX_REQUIRED",
     [("Aadhaar Card", 95), ("PAN Card", 91), ("Bank Passbook", 93)], 93),
    ("rto_dl_update", "rto", RTO_DOCS, (3, 0, 1), {"Driving License": 1, "Aadhaar Card": 1}, "Driving License", 93.2, "READY",
     [("Driving License", 90), ("Aadhaar Card", 84)], 87),
    ("scheme_apply", "scheme", SCHEME_DOCS, (0, 3, 0), {}, None, 98.6, "READY", [("Aadhaar Card", 95), ("Ration Card", 91)], 93),
    ("pan_aadhaar_link", "pan", BASE_DOCS, (1, 7, 0), {}, None, 99.1, "READY",
     [("Aadhaar Card", 93), ("PAN Card", 93), ("Bank Passbook", 93)], 93),
    ("grievance_complaint", "complaint", BASE_DOCS, (1, 7, 0), {}, None, 100.0, "READY",
     [("Aadhaar Card", 95), ("PAN Card", 91), ("Bank Passbook", 93)], 93),
]
