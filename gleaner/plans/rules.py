"""The detection rules, as data that plans are generated from.

Order matters: of findings that tie, the earlier rule's stays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checks, text


@dataclass(frozen=True)
class Rule:
    type: str
    subtype: str
    category: str
    patterns: tuple[str, ...]
    risk: str
    flags: str  # HIPAA, CCPA, PIPEDA, notification: Y or N
    base: float
    least: float
    method: str
    context: tuple[str, ...]
    strong: tuple[str, ...]
    negative: tuple[str, ...] = ()
    group: int = 0
    width: int = 100
    needs_context: bool = False
    valid: Callable[[Column], Column] | None = None
    normal: Callable[[Column], Column] = field(default=text.collapse)
    keep: str = ""
    shape: Callable[[Column], Column] | None = None  # what valid asks of values that are known to be real


def _w(words: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in words.split(",") if x.strip())


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_ABBREVIATED = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
_DAY, _YEAR = "(?:0?[1-9]|[12]\\d|3[01])", "(?:19\\d{2}|20\\d{2})"
_NO_ORDERS = "order number, invoice number, confirmation number"
_NAME = "([A-Z][A-Za-z'.-]+(?: [A-Z][A-Za-z'.-]+){1,3})\\b"

# A card written in one run of digits is one by itself: digits of other numbers beside it are not read as its own.
# Shapes, weights and words of each rule. All shapes ignore case, and ^ and $ are a line's ends.
RULES = [
    Rule("SSN", "social_security_number", "government_identifier", (r"(?=\d)\b(?!000|666|9\d{2})([0-6]\d{2}|[789][0-1]\d)[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b",), "HIGH", "YYNY", 0.97, 0.95, "regex+structure",
         _w("ssn, social security, social security number"), _w("ssn, social security number"), normal=text.digits_only, keep="ssn"),
    Rule("SIN", "social_insurance_number", "government_identifier", (r"\b[1-9]\d{2}[-\s]?\d{3}[-\s]?\d{3}\b",), "HIGH", "NNYY", 0.82, 0.82, "regex+checksum",
         _w("sin, social insurance, social insurance number, insurance number, numéro d'assurance sociale"), _w("sin, social insurance number"), needs_context=True, valid=checks.sin, normal=text.digits_only),
    Rule("CREDIT_CARD", "payment_card_number", "financial", (r"(?<!\d)\d{13,19}(?!\d)", r"(?<!\d)(?:\d(?!\d{12})[ -]?){13,19}(?!\d)"), "HIGH", "NYYY", 0.84, 0.80, "regex+checksum",
         _w("card, credit, debit, visa, mastercard, amex, discover, payment"), _w("card number, credit card, debit card"), _w(_NO_ORDERS), valid=checks.luhn, normal=text.digits_only),
    Rule("BANK_ACCOUNT", "routing_number", "financial", (r"\b(?:routing|aba|transit)(?:\s+(?:number|no\.?|#))?[\s#:.,-]*([0-9]{9})\b",), "HIGH", "NYYY", 0.91, 0.88, "regex+label+checksum",
         _w("routing, aba, transit, bank, ach"), _w("routing, aba, transit number"), group=1, width=150, valid=checks.aba, normal=text.digits_only),
    Rule("BANK_ACCOUNT", "account_number", "financial", (r"\b(?:bank\s+account|account|acct|checking|savings)(?:\s+(?:number|no\.?|#))?[\s#:.,-]*([0-9][0-9 -]{5,24}[0-9])\b",), "HIGH", "NYYY", 0.86, 0.84, "regex+label",
         _w("account, acct, bank, checking, savings"), _w("account number, acct #, bank account"), _w(_NO_ORDERS), group=1, width=150, valid=checks.bank_account, normal=text.digits_only, keep="bank"),
    Rule("PASSPORT", "passport_number", "government_identifier", (r"\b(?:passport|passeport)(?:\s+(?:number|no\.?|#))?[\s#:.,-]*([A-Z0-9][A-Z0-9 -]{5,15})\b",), "HIGH", "NYYY", 0.87, 0.84, "regex+label",
         _w("passport, travel document, passeport"), _w("passport, passport number, passport no"), group=1, width=150, valid=checks.passport, normal=text.compact_alnum),
    Rule("DRIVERS_LICENSE", "drivers_license_number", "government_identifier", (r"\b(?:driver'?s?[_\s]+licen[sc]e|drivers?[_\s]+licen[sc]e|driving[_\s]+licen[sc]e)(?:[_\s]+(?:number|no\.?|#))?[\s#:.,-]*([A-Z0-9][A-Z0-9 -]{4,24})\b",), "HIGH", "NYYY", 0.84, 0.82, "regex+label",
         _w("driver's license, drivers license, driving licence, driving license"), _w("driver's license, drivers license, driver license number"), group=1, width=200, valid=checks.drivers_license, normal=text.compact_alnum),
    Rule("MEDICARE", "medicare_beneficiary_identifier", "health_identifier", (r"\b[1-9][AC-HJ-NP-RT-Y]{2}[0-9][AC-HJ-NP-RT-Y]{2}[0-9][AC-HJ-NP-RT-Y]{2}[0-9]{2}\b",), "HIGH", "YNNY", 0.96, 0.92, "regex+structure",
         _w("medicare, mbi"), _w("medicare, medicare number, mbi"), normal=text.compact_alnum),
    Rule("MRN", "medical_record_number", "health_identifier", (r"\b(?:MRN|MED(?:ICAL)?[_\s]+REC(?:ORD)?(?:[_\s]+NUMBER)?|RECORD[_\s]+NUMBER)[#\s:.,-]*([A-Z0-9]{4,12})\b",), "HIGH", "YNNY", 0.88, 0.84, "regex+label",
         _w("mrn, medical record, record number"), _w("mrn, medical record number"), group=1, width=150, valid=checks.mrn, shape=checks.mrn_shape, normal=text.compact_alnum),
    Rule("NPI", "national_provider_identifier", "professional_identifier", (r"\b(?:npi|national\s+provider(?:\s+(?:identifier|id|number))?)[\s#:.,-]*([0-9]{10})\b",), "MEDIUM", "YNNN", 0.86, 0.84, "regex+label+checksum",
         _w("npi, provider identifier, provider id"), _w("npi, national provider identifier"), group=1, width=150, valid=checks.npi, normal=text.digits_only),
    Rule("IBAN", "international_bank_account_number", "financial", (r"\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{2,4}){3,8}\b",), "MEDIUM", "NYYN", 0.88, 0.86, "regex+checksum",
         _w("iban, account, bank, wire, transfer"), _w("iban, international bank account"), valid=checks.iban, normal=text.compact_alnum),
    Rule("EIN", "employer_identification_number", "government_identifier", (r"\b(?:ein|fein|employer\s+identification(?:\s+number)?|federal\s+tax(?:\s+id(?:entification)?(?:\s+number)?)?)[\s#:.,-]*((?:0[1-9]|[1-9]\d)[- ]?\d{7})\b",), "LOW", "NYNN", 0.80, 0.78, "regex+label",
         _w("ein, fein, employer identification, federal tax"), _w("ein, employer identification number, federal tax id"), group=1, normal=text.digits_only),
    Rule("DOB", "date_of_birth", "personal_profile", (
            r"\b(?:19\d{2}|20\d{2})[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])\b", r"\b(?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12]\d|3[01])[/-](?:19\d{2}|20\d{2}|\d{2})\b",
            rf"\b(?:{_MONTHS})\s+{_DAY},?\s+{_YEAR}\b", rf"\b(?:{_ABBREVIATED})\s+{_DAY},?\s+{_YEAR}\b", rf"\b{_DAY}\s+(?:{_MONTHS}|{_ABBREVIATED})\s+{_YEAR}\b"),
         "MEDIUM", "YYYN", 0.72, 0.72, "regex+validation",
         _w("dob, date of birth, birth date, birthdate, birthday, born"), _w("dob, date of birth, birthdate"),
         _w("deadline, due, appointment, meeting, hearing, scheduled, renewal, effective, expires, expiration, service date, service dates, adoption date, training, inspection, audit"), valid=checks.dob, normal=checks.dob_iso, keep="dob"),
    Rule("ADDRESS", "street_address", "location", (r"\b\d{1,6}\s+(?:[A-Za-z0-9.'#-]+\s+){1,6}(?:St|Street|Ave|Avenue|Blvd|Boulevard|Dr|Drive|Rd|Road|Ln|Lane|Way|Ct|Court|Pl|Place|Terr|Terrace|Pkwy|Parkway|Cir|Circle|Hwy|Highway)\b(?:,?\s*(?:Apt|Apartment|Unit|Suite|Ste|#)\s*[A-Za-z0-9-]+)?(?:,?\s*[A-Za-z .'-]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?)?",), "MEDIUM", "YYYN", 0.80, 0.78, "regex+structure",
         _w("address, street, mailing, home, residence"), _w("address, mailing address, home address"), normal=text.upper_collapsed),
    Rule("FULL_NAME", "full_name", "identity", (
            r"\b(?:full\s+name|name|record\s+owner|patient\s+name|employee\s+name|member\s+name|student\s+name|borrower\s+name|applicant\s+name|customer\s+name|client\s+name|insured\s+name|subscriber\s+name|dependent\s+name|guarantor\s+name)\b\s*[:#,\-]\s*" + _NAME,
            r"\b(?:patient|employee|member|student|borrower|applicant|customer|client|insured|subscriber|dependent|guarantor|spouse|child|parent)\b\s*[:#-]\s*" + _NAME),
         "LOW", "YYYN", 0.83, 0.82, "regex+label",
         _w("name, patient, employee, member, student"), _w("full name, name, patient, employee, member"), group=1, valid=checks.full_name, normal=text.upper_collapsed),
    Rule("ZIP", "postal_code", "location", (r"\b\d{5}(?:-\d{4})?\b", r"\b[A-Z]\d[A-Z][ -]?\d[A-Z]\d\b"), "MEDIUM", "YYYN", 0.54, 0.72, "regex+context",
         _w("zip, zipcode, postal, postal code, postcode"), _w("zip, zip code, postal code"), needs_context=True, normal=text.compact_alnum),
    Rule("EMAIL", "email_address", "contact", (r"\b(?=[A-Za-z0-9._%+\-]{1,64}+@)[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b",), "MEDIUM", "YYYN", 0.98, 0.95, "regex",
         _w("email, e-mail, mail, contact"), _w("email, email address, e-mail"), normal=lambda v: F.lower(F.trim(v)), keep="email"),
    Rule("PHONE", "phone_number", "contact", (r"(?<!\w)(?:\+?1[-.\s]?)?(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[-.\s]?[2-9][0-9]{2}[-.\s]?[0-9]{4}(?:\s*(?:x|ext\.?)\s*[0-9]{1,6})?(?!\w)",), "MEDIUM", "YYYN", 0.66, 0.70, "regex+context",
         _w("phone, tel, telephone, mobile, cell, fax, call, contact"), _w("phone, phone number, telephone, mobile, cell"), _w("contact, call, support, helpdesk, service desk, customer care, questions"), needs_context=True, normal=text.phone_digits, keep="phone"),
    Rule("VIN", "vehicle_identification_number", "vehicle_identifier", (r"\b[A-HJ-NPR-Z0-9]{17}\b",), "MEDIUM", "NYYN", 0.78, 0.80, "regex+context",
         _w("vin, vehicle, auto, car, vehicle id"), _w("vin, vehicle identification number"), needs_context=True, normal=text.compact_alnum),
    Rule("ICD10", "diagnosis_code", "health_information", (r"\b[A-Z][0-9]{2}(?:\.[0-9A-Z]{1,4})?\b",), "MEDIUM", "YNNN", 0.74, 0.78, "regex+context",
         _w("diagnosis, icd, dx, condition, diagnostic"), _w("icd, icd-10, diagnosis"), needs_context=True, normal=text.compact_alnum),
    Rule("NDC", "drug_code", "health_information", (r"\b(?:\d{5}-\d{4}-\d{2}|\d{5}-\d{3}-\d{2}|\d{4}-\d{4}-\d{2})\b",), "MEDIUM", "YNNN", 0.74, 0.78, "regex+context",
         _w("ndc, drug, medication, prescription, pharmaceutical, rx"), _w("ndc, drug code, prescription"), needs_context=True, normal=text.digits_only),
    Rule("IPV4", "ipv4_address", "online_identifier", (r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})\b",), "LOW", "NYYN", 0.92, 0.90, "regex+context",
         _w("ip, ip address, login, device"), _w("ip, ip address"), _w("intrusion, firewall, server, port, ssh, failed login, cpu, monitoring"), needs_context=True, normal=text.digits_only, keep="ipv4"),
]

# Words of the match filters.
WORDS = {
    "record": _w("patient, member, employee, customer, client, subscriber, insured, dependent, child, student, borrower, applicant, claimant, spouse, resident, guarantor, address, phone, email, mrn, medical record, member id, patient id, subscriber id"),
    "dob_record": _w("patient, member id, patient id, subscriber id, insured, dependent, child, spouse, guarantor, address, mrn, medical record"),
    "dob_explicit": _w("dob, date of birth, birth date, birthdate, born, d.o.b"),
    "dob_negative": _w("deadline, due, appointment, meeting, hearing, scheduled, schedule, renewal, effective, expires, expiration, install, installation, delivery, service date, service dates, adoption date, admission, discharge, court date, start date, termination date, incident date, outage date, marriage date, divorce date, issued, issue date, payment, balance, billing, statement date, training, inspection, audit, launch, maintenance, arrival, arriving, departure, pick-up, drop-off"),
    "email_label": _w("email, e-mail, email address"),
    "email_person": _w("patient email, employee email, member email, customer email, personal email"),
    "email_service": _w("support, helpdesk, service desk, questions, customer care, account management, property management, quality assurance, human resources, facilities, licensing, coordinator, assigned coordinator, inbox"),
    "phone_label": _w("phone, phone number, telephone, tel, mobile, cell"),
    "phone_negative": _w("contact, call, support, helpdesk, service desk, customer care, questions, balance inquiry, recall, administrator, department, office"),
    "bank_positive": _w("bank account, checking, savings, direct deposit, ach, routing, wire, deposit account"),
    "bank_negative": _w("loan, gift card, claim, policy, invoice, order, payment due, balance, statement, membership, member, customer care, suspended, autopay"),
    "ssn_label": _w("ssn, social security, social security number"),
    "ssn_negative": _w("ndc, drug, medication, prescription, rx"),
    "ip_label": _w("ip, ip address, source ip, client ip, origin ip"),
    "ip_person": _w("login, sign in, sign-in, session, device, portal, browser, user agent"),
    "ip_negative": _w("intrusion, firewall, server, port, ssh, failed login, cpu, monitoring, web-server, alert, network team, operations, ticket"),
    "generic_mailbox": _w("admin, audit, alert, alerts, billing, benefits, compliance, contact, contracts, customercare, dpo, facilities, help, helpdesk, intake, inbox, info, it, legal, licensing, marketing, noreply, no-reply, office, ops, operations, privacy, recall, sales, security, service, support, team"),
    "generic_part": _w("support, help, billing, contact, info, admin, intake, privacy, benefits, care, ops, alert, notice, service, security"),
    "webmail": _w("aol.com, gmail.com, hotmail.com, icloud.com, live.com, msn.com, outlook.com, protonmail.com, yahoo.com"),
}
LIKELY_NAME = r"\b[A-Z][A-Za-z'.-]+(?:\s+[A-Z][A-Za-z'.-]+){1,2}\b"
# Marks of made-up data.
TEST_MARKERS = ["[sample]", "[test]", "[placeholder]", "[fake]", "sample ", "test ", "demo ", "mock ", "example "]
FAKE_VALUES = ["123456789", "5555550000", "4532123456789010", "9876543210"]
FAKE_MAILBOXES = ["test@example.com", "test@test.com", "demo@demo.com", "sample@example.com", "example@example.com", "user@test.com", "admin@test.com"]
# Weight of each type in a risk score.
RISK_WEIGHTS = {"SSN": 10.0, "SIN": 10.0, "CREDIT_CARD": 10.0, "BANK_ACCOUNT": 9.0, "PASSPORT": 9.0, "DRIVERS_LICENSE": 8.0, "MEDICARE": 8.0, "MRN": 7.0, "IBAN": 7.0, "DOB": 6.0, "ADDRESS": 5.0, "ICD10": 5.0, "NDC": 4.0, "VIN": 4.0, "EMAIL": 3.0, "PHONE": 3.0, "NPI": 2.5, "FULL_NAME": 2.0, "ZIP": 2.0, "EIN": 2.0, "IPV4": 1.0}
