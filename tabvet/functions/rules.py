"""Fixed values that must equal the reference's: name patterns, category tags, domain constraints,
keyword lists. Stated as plain data, in the reference's order (first match wins)."""

from __future__ import annotations

# ---- fixed values: semantic type name patterns (case-insensitive search, first match wins) ----
SEMANTIC_PATTERNS = [
    ("primary_key", r"(?i)(^id$|_id$|^pk$|^key$|^uuid|^guid|identifier|record.?id)"),
    ("foreign_key", r"(?i)(_fk$|_ref$|parent.?id|related.?id)"),
    ("name", r"(?i)(^name$|_name$|first.?name|last.?name|full.?name|customer.?name|user.?name|product.?name|item.?name)"),
    ("email", r"(?i)(email|e.?mail|mail.?address)"),
    ("phone", r"(?i)(phone|mobile|tel|contact.?num|cell)"),
    ("address", r"(?i)(address|street|city|state|zip|postal|country|location|region)"),
    ("url", r"(?i)(url|link|website|href|uri)"),
    ("ip_address", r"(?i)(ip|ip.?address|ipv4|ipv6)"),
    ("age", r"(?i)(^age$|_age$|years.?old|customer.?age|user.?age)"),
    ("gender", r"(?i)(gender|sex|male.?female)"),
    ("birth_date", r"(?i)(birth|dob|date.?of.?birth|born)"),
    ("marital_status", r"(?i)(marital|married|single|divorced)"),
    ("education", r"(?i)(education|degree|school|university|qualification)"),
    ("occupation", r"(?i)(occupation|job|profession|work|employment|career|title)"),
    ("price", r"(?i)(price|cost|amount|fee|charge|rate|value|msrp)"),
    ("revenue", r"(?i)(revenue|sales|total.?amount|gross)"),
    ("profit", r"(?i)(profit|margin|gain|net|earnings)"),
    ("income", r"(?i)(income|salary|wage|pay|compensation|annual)"),
    ("discount", r"(?i)(discount|promo|coupon|rebate|reduction)"),
    ("tax", r"(?i)(tax|vat|gst|duty)"),
    ("currency", r"(?i)(currency|curr|money.?type)"),
    ("balance", r"(?i)(balance|credit|debit|account.?amt)"),
    ("quantity", r"(?i)(quantity|qty|count|num|number.?of|total.?count|units)"),
    ("percentage", r"(?i)(percent|pct|ratio|rate$|proportion)"),
    ("score", r"(?i)(score|rating|rank|grade|points|stars)"),
    ("size", r"(?i)(size|dimension|length|width|height|area|volume)"),
    ("weight", r"(?i)(weight|mass|wt$|kg$|lbs)"),
    ("duration", r"(?i)(duration|time.?spent|minutes|hours|days|length.?of)"),
    ("distance", r"(?i)(distance|miles|km|meters|feet)"),
    ("date", r"(?i)(date|dt$|day$|created|updated|modified|timestamp)"),
    ("year", r"(?i)(^year$|yr$|fiscal.?year|calendar.?year)"),
    ("month", r"(?i)(^month$|mon$|mm$)"),
    ("quarter", r"(?i)(quarter|qtr|q[1-4])"),
    ("datetime", r"(?i)(datetime|timestamp|ts$|time$)"),
    ("time_of_day", r"(?i)(time.?of.?day|hour|am.?pm)"),
    ("status", r"(?i)(status|state|condition|stage|phase)"),
    ("type", r"(?i)(type|category|class$|kind|group|segment)"),
    ("level", r"(?i)(level|tier|grade|priority|severity)"),
    ("flag", r"(?i)(flag|is.?|has.?|can.?|should|active|enabled|valid)"),
    ("product_id", r"(?i)(product.?id|item.?id|sku|upc|ean|asin)"),
    ("product_name", r"(?i)(product.?name|item.?name|title|description)"),
    ("brand", r"(?i)(brand|manufacturer|vendor|supplier|maker)"),
    ("order_id", r"(?i)(order.?id|order.?num|transaction.?id|invoice)"),
    ("customer_id", r"(?i)(customer.?id|client.?id|user.?id|buyer.?id)"),
    ("shipping", r"(?i)(shipping|delivery|freight|postage)"),
    ("inventory", r"(?i)(inventory|stock|available|in.?stock|on.?hand)"),
    ("campaign", r"(?i)(campaign|promo|ad|advertisement|marketing)"),
    ("channel", r"(?i)(channel|source|medium|platform|referrer)"),
    ("clicks", r"(?i)(click|impression|view|visit|hit)"),
    ("conversion", r"(?i)(conversion|convert|signup|subscribe|purchase)"),
    ("employee_id", r"(?i)(employee.?id|emp.?id|staff.?id|worker.?id)"),
    ("department", r"(?i)(department|dept|division|unit|team)"),
    ("hire_date", r"(?i)(hire|join|start.?date|employment.?date)"),
    ("tenure", r"(?i)(tenure|years.?employed|experience|seniority)"),
    ("performance", r"(?i)(performance|review|evaluation|appraisal)"),
    ("sensor_id", r"(?i)(sensor.?id|device.?id|node.?id|equipment.?id)"),
    ("reading", r"(?i)(reading|measurement|value|signal|output)"),
    ("temperature", r"(?i)(temp|temperature|celsius|fahrenheit|thermal)"),
    ("pressure", r"(?i)(pressure|psi|bar|pascal)"),
    ("voltage", r"(?i)(voltage|volt|v$|current|amp)"),
    ("frequency", r"(?i)(frequency|freq|hz|hertz)"),
    ("error_code", r"(?i)(error|fault|alert|warning|code)"),
    ("latitude", r"(?i)(lat|latitude)"),
    ("longitude", r"(?i)(lon|lng|longitude)"),
    ("coordinates", r"(?i)(coord|geo|location)"),
    ("zip_code", r"(?i)(zip|postal|postcode)"),
    ("country_code", r"(?i)(country.?code|iso.?country)"),
    ("patient_id", r"(?i)(patient.?id|medical.?record|mrn)"),
    ("diagnosis", r"(?i)(diagnosis|condition|disease|illness)"),
    ("medication", r"(?i)(medication|drug|prescription|medicine)"),
    ("dosage", r"(?i)(dosage|dose|mg|ml)"),
    ("blood_pressure", r"(?i)(blood.?pressure|bp|systolic|diastolic)"),
    ("heart_rate", r"(?i)(heart.?rate|pulse|bpm)"),
    ("lab_result", r"(?i)(lab|test.?result|specimen)"),
    ("target", r"(?i)(target|label|outcome|result|class$|predict|y$|response|dependent)"),
    ("binary_outcome", r"(?i)(churn|default|fraud|spam|click|convert|buy|cancel|return)"),
]

# ---- fixed values: semantic category tags (types not listed -> 'Feature') ----
CATEGORY_MAP = {
    "user_id": "Identifier", "patient_id": "Identifier", "order_id": "Identifier", "transaction_id": "Identifier",
    "product_id": "Identifier", "email": "Identifier", "phone": "Identifier", "ssn": "Identifier",
    "age": "Demographic", "gender": "Demographic", "sex": "Demographic", "ethnicity": "Demographic", "race": "Demographic",
    "marital_status": "Demographic", "education": "Demographic",
    "systolic_bp": "Clinical_Metric", "diastolic_bp": "Clinical_Metric", "blood_pressure": "Clinical_Metric",
    "cholesterol": "Clinical_Metric", "glucose": "Clinical_Metric", "heart_rate": "Clinical_Metric", "bmi": "Clinical_Metric",
    "weight": "Clinical_Metric", "height": "Clinical_Metric", "dosage": "Clinical_Metric",
    "smoking": "Lifestyle_Factor", "alcohol": "Lifestyle_Factor", "exercise": "Lifestyle_Factor", "diet": "Lifestyle_Factor",
    "sleep_hours": "Lifestyle_Factor",
    "income": "Financial", "salary": "Financial", "revenue": "Financial", "price": "Financial", "cost": "Financial",
    "profit": "Financial",
    "latitude": "Geographic", "longitude": "Geographic", "city": "Geographic", "country": "Geographic", "zipcode": "Geographic",
    "postal_code": "Geographic",
    "timestamp": "Temporal", "date": "Temporal", "created_at": "Temporal",
    "temperature": "Technical", "pressure": "Technical", "voltage": "Technical", "frequency": "Technical",
}

# ---- fixed values: domain constraints per semantic type (min, max, type) ----
DOMAIN_CONSTRAINTS = {
    "quantity": (0, None, "int"), "age": (0, 150, "int"), "year": (1900, 2100, "int"), "inventory": (0, None, "int"),
    "clicks": (0, None, "int"),
    "price": (0, None, "float"), "revenue": (0, None, "float"), "income": (0, None, "float"), "weight": (0, None, "float"),
    "distance": (0, None, "float"), "duration": (0, None, "float"), "size": (0, None, "float"), "shipping": (0, None, "float"),
    "tax": (0, None, "float"),
    "percentage": (0, 100, "float"), "conversion": (0, 100, "float"), "score": (0, 100, "float"),
    "latitude": (-90, 90, "float"), "longitude": (-180, 180, "float"),
    "temperature": (-273.15, None, "float"), "pressure": (0, None, "float"), "voltage": (None, None, "float"),
    "frequency": (0, None, "float"),
    "heart_rate": (20, 300, "float"), "dosage": (0, None, "float"),
}

# ---- fixed values: column categorisation name fragments (substring match) ----
ID_PATTERNS = ["id", "uuid", "key", "_id", "index", "serial", "code"]
TARGET_PATTERNS = ["target", "label", "class", "outcome", "result", "y_", "is_", "has_"]
TEMPORAL_PATTERNS = ["date", "time", "timestamp", "created", "updated", "year", "month", "day"]

# ---- fixed values: domain keywords (substring of the lower-cased, space-joined column names) ----
DOMAIN_KEYWORDS = [
    ("FINANCE", ["price", "amount", "revenue", "cost", "profit", "loss", "balance", "payment", "transaction", "invoice",
                 "salary", "income", "expense", "stock", "share", "dividend", "interest", "loan", "credit", "debit"]),
    ("RETAIL", ["product", "item", "quantity", "order", "customer", "purchase", "cart", "sku", "inventory", "discount",
                "sale", "return", "shipping"]),
    ("HEALTHCARE", ["patient", "diagnosis", "symptom", "treatment", "medication", "blood", "pressure", "heart", "bmi",
                    "cholesterol", "glucose"]),
    ("TEMPORAL", ["date", "time", "timestamp", "created", "updated", "modified", "year", "month", "day", "hour", "minute",
                  "period", "duration"]),
    ("GEOSPATIAL", ["latitude", "longitude", "lat", "lng", "lon", "city", "country", "state", "region", "zip", "postal",
                    "address", "location"]),
    ("IDENTITY", ["id", "uuid", "key", "code", "number", "index", "serial"]),
]

# ---- fixed values: whole-value patterns for value_patterns (anchored) ----
VALUE_PATTERNS = [
    ("EMAIL", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
    ("PHONE", r"^[\+]?[(]?[0-9]{3}[)]?[-\s\.]?[0-9]{3}[-\s\.]?[0-9]{4,6}$"),
    ("URL", r"^https?://[^\s]+$"),
    ("IP_ADDRESS", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
    ("CREDIT_CARD", r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$"),
    ("SSN", r"^\d{3}-\d{2}-\d{4}$"),
    ("ZIP_CODE", r"^\d{5}(-\d{4})?$"),
    ("DATE_ISO", r"^\d{4}-\d{2}-\d{2}$"),
    ("PERCENTAGE", r"^-?\d+\.?\d*%$"),
]

# ---- fixed values: target-candidate name pattern ----
TARGET_NAME_PATTERN = r"(?i)(target|label|class|outcome|result|y$|predict)"

# ---- fixed values: sensitive-attribute name patterns (first match wins) ----
SENSITIVE_PATTERNS = [
    ("gender", r"(?i)(gender|sex|male|female)"),
    ("age_group", r"(?i)(age.?group|age.?cat|generation)"),
    ("race", r"(?i)(race|ethnic|ethnicity)"),
    ("religion", r"(?i)(religion|faith)"),
    ("marital", r"(?i)(marital|married|single|divorced)"),
    ("education", r"(?i)(education|degree|school)"),
    ("income_group", r"(?i)(income.?group|salary.?cat|wealth)"),
]

# ---- fixed values: domain feature rules (name, required roles, description), in rule order ----
FEATURE_RULES = [
    ("bmi", ["weight", "height"], "Body Mass Index = weight / height^2"),
    ("pulse_pressure", ["systolic", "diastolic"], "Pulse Pressure = Systolic - Diastolic"),
    ("mean_arterial_pressure", ["systolic", "diastolic"], "MAP = (Systolic + 2*Diastolic) / 3"),
    ("debt_to_income", ["debt", "income"], "Debt-to-Income Ratio = debt / income"),
    ("savings_rate", ["savings", "income"], "Savings Rate = savings / income"),
    ("profit_margin", ["profit", "revenue"], "Profit Margin = profit / revenue"),
    ("conversion_rate", ["purchases", "visits"], "Conversion Rate = purchases / visits"),
    ("avg_order_value", ["revenue", "orders"], "Average Order Value = revenue / orders"),
    ("age_tenure_ratio", ["age", "tenure"], "Age-Tenure Ratio (career stage indicator)"),
    ("experience_ratio", ["experience", "age"], "Experience Ratio = experience / (age - 18)"),
]

# ---- fixed values: column roles for the domain feature rules (first matching role per column) ----
FEATURE_ROLE_PATTERNS = [
    ("weight", r"(?i)(weight|mass|wt|kg)"),
    ("height", r"(?i)(height|ht|cm|meters?)"),
    ("systolic", r"(?i)(systolic|sys|sbp|systolic.?bp)"),
    ("diastolic", r"(?i)(diastolic|dia|dbp|diastolic.?bp)"),
    ("age", r"(?i)(age|years?|yr)"),
    ("income", r"(?i)(income|salary|wage|earning|pay)"),
    ("debt", r"(?i)(debt|loan|owe|liability)"),
    ("savings", r"(?i)(saving|balance|deposit)"),
    ("profit", r"(?i)(profit|net.?income|earnings)"),
    ("revenue", r"(?i)(revenue|sales|gross)"),
    ("purchases", r"(?i)(purchase|order|buy|transaction)"),
    ("visits", r"(?i)(visit|session|view|click)"),
    ("orders", r"(?i)(order|transaction|purchase)"),
    ("tenure", r"(?i)(tenure|years?.?employed|service.?years?)"),
    ("experience", r"(?i)(experience|exp|years?.?exp)"),
]

# ---- fixed values: age groups for the fairness fallback (right-closed bins) ----
AGE_GROUP_EDGES = [0, 30, 50, 100]
AGE_GROUP_LABELS = ["Young", "Middle", "Senior"]
