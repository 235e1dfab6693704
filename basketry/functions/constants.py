"""Fixed values.

Everything below must equal the analysed workload's values for results to
match; they are stated as plain data, in their natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — feature definitions of the shopper workload
# ---------------------------------------------------------------------------

# purchases per year for each frequency text (unknown text -> null)
FREQUENCY_PER_YEAR = {
    "Weekly": 52, "Bi-Weekly": 26, "Fortnightly": 26, "Quarterly": 4,
    "Annually": 1, "Monthly": 12, "Every 3 Months": 4,
}

# payment method -> payment type (unknown -> null)
PAYMENT_TYPE = {
    "Cash": "Cash", "Credit Card": "Card", "Debit Card": "Card",
    "PayPal": "Online", "Venmo": "Online", "Bank Transfer": "Online",
}

# right-closed age bins (0,30] (30,45] (45,56] (56,200]
AGE_EDGES = [0, 30, 45, 56, 200]
AGE_LABELS = ["18-30", "31-45", "46-56", "57-70"]

# loyalty bins [0,13] (13,25] (25,38] (38,200]
LOYALTY_EDGES = [0, 13, 25, 38, 200]
LOYALTY_LABELS = ["Low", "Mid", "High", "Very High"]

# quartile labels of the purchase amount; quartile scores of loyalty
AMOUNT_QUARTILE_LABELS = ["Low", "Mid", "High", "Very High"]
LOYALTY_SCORE_LABELS = [1, 2, 3, 4]

# climate of each state, first list that holds the state wins; else Unknown
CLIMATE_STATES = [
    ("Cold", ["Alaska", "North Dakota", "South Dakota", "Minnesota", "Wisconsin", "Michigan",
              "Montana", "Wyoming", "Maine", "Vermont", "New Hampshire"]),
    ("Cool", ["Massachusetts", "Connecticut", "Rhode Island", "New York", "Pennsylvania",
              "New Jersey", "Ohio", "Indiana", "Illinois", "Iowa", "Nebraska", "Kansas",
              "Colorado", "Utah", "Idaho", "Washington", "Oregon"]),
    ("Warm", ["Virginia", "Maryland", "Delaware", "Kentucky", "Missouri", "West Virginia",
              "North Carolina", "Tennessee", "Arkansas", "Oklahoma"]),
    ("Hot", ["Florida", "Texas", "Louisiana", "Mississippi", "Alabama", "Georgia",
             "South Carolina", "Arizona", "Nevada", "New Mexico", "California"]),
    ("Tropical", ["Hawaii"]),
]
CLIMATE_UNKNOWN = "Unknown"

RARE_LABEL = "Rare"
OTHER_LABEL = "Other"
TOP_LOCATIONS = 10
RARE_SHARE = 0.01
ASSOCIATION_LIMIT = 0.8
NULL_TEXT = "nan"  # how a missing value prints inside a concatenated feature

# leakage features (derived from the label) and the one-hot drop list
LEAKAGE_COLUMNS = ["SUB_FREQ_NEW", "PROMO_NO_SUB_NEW", "SHIP_SUB_NEW"]
MODEL_DROP_COLUMNS = [
    "CUSTOMER_ID", "SUBSCRIPTION_STATUS", "ITEM_PURCHASED", "LOCATION", "COLOR", "SIZE",
    "FREQUENCY_OF_PURCHASES", "PAYMENT_METHOD", "SHIPPING_TYPE",
    "PURCHASE_AMOUNT_USD", "PREVIOUS_PURCHASES", "REVIEW_RATING",
    "AGE", "DISCOUNT_APPLIED", "SEASON", "PROMO_CODE_USED",
]

# decision-threshold grid 0.05 .. 0.95 step 0.05, target recalls, fallback
THRESHOLD_STEPS = 19
THRESHOLD_STEP = 0.05
TARGET_RECALL_V2 = 0.85
TARGET_RECALL_V1 = 0.80
DEFAULT_THRESHOLD = 0.50

# segment names and action classes of the five segments, in rank order of
# the mean weighted spend (rank 1 = highest)
SEGMENT_NAMES_BY_RANK = ["VIP'e En Yakınlar", "Avantaj Avcıları", "Büyük Sepetliler",
                         "Kararsızlar", "Sessiz Kitle"]
SEGMENT_ACTIONS_BY_RANK = ["Upsell / Premium", "Upsell / Premium", "Nurture / Education",
                           "Winback / Aggressive Promo", "Winback / Aggressive Promo"]
SEGMENT_NAME_DEFAULT = "Genel Segment"
SEGMENT_ACTION_DEFAULT = "Genel"

# recommended steps for each action class
PLAYBOOK = {
    "Upsell / Premium": [
        "Premium/Plus abonelik: ücretsiz kargo + özel kampanya erişimi",
        "Checkout ve satın alma sonrası 1 tık abonelik önerisi",
        "30 gün deneme veya ilk 3 ay indirim (A/B test)",
    ],
    "Nurture / Education": [
        "Tasarruf simülasyonu: 'Abone olsaydınız X₺ daha az öderdiniz'",
        "Fayda anlatımı: fiyat değil, değer ve avantaj",
        "Email drip: 3 adım (fayda → örnek hesap → CTA)",
    ],
    "Winback / Aggressive Promo": [
        "48 saatlik teklif + FOMO mesaj",
        "SMS/Push ağırlıklı yeniden aktivasyon",
        "Kısa anket + kişiselleştirme",
    ],
}

# CRM action of a segment: rate >= mean rate? x spend >= median spend?
CRM_UPSELL = "Upsell / Premium teklif"
CRM_QUICK_WIN = "Quick win / light incentive"
CRM_RETENTION = "Retention / özel ilgi"
CRM_WINBACK = "Winback / agresif promosyon"

# rule-based segment names: spend level by global quartiles, age group,
# promo behaviour
SPEND_LEVELS = ["VIP", "Yüksek Değerli", "Orta Değerli", "Potansiyel"]
AGE_GROUPS = [(30, "Genç"), (45, "Orta Yaş")]
AGE_GROUP_ELSE = "Olgun"
PROMO_TYPES = [(60, "Fırsat Avcısı"), (30, "Promosyon Duyarlı")]
PROMO_TYPE_ELSE = "Sadık"

# actions for segments below the mean subscription rate
RISK_ACTION_AGGRESSIVE = "Agresif abonelik kampanyası (ilk 3 ay %50 indirim)"
RISK_ACTION_MODERATE = "Orta düzey abonelik teşviki (ilk ay %30 indirim)"
RISK_ACTION_VIP = "VIP müşteri programı sun (premium avantajlar)"
RISK_ACTION_SURVEY = "Müşteri memnuniyeti anketleri ve iyileştirme planı"
RISK_ACTION_LOYALTY = "Sadakat programı ve tekrar satın alma teşvikleri"
RISK_ACTION_REWARD = "Sadık müşteri ödüllendirme programı"

# recommendation for a scored customer from its segment's subscription rate
REC_LOW = "Agresif abonelik kampanyası uygulayın"
REC_MID = "Kişiselleştirilmiş teklifler sunun"
REC_HIGH = "Sadakat programı ile uzun vadeli bağ kurun"
REC_BOTH_HIGH = "Hem model hem de segment abone olma olasılığı yüksek!"
REC_BOTH_LOW = "Hem model hem de segment düşük abonelik gösteriyor - Dikkatli yaklaşın"

# ---------------------------------------------------------------------------
# FIXED VALUES — the ``shop`` test view derived from the driver tables
# ---------------------------------------------------------------------------
NATION_STATE = {
    0: "Alaska", 1: "Minnesota", 2: "Montana", 3: "Maine", 4: "Vermont",
    5: "Massachusetts", 6: "New York", 7: "Ohio", 8: "Illinois", 9: "Colorado",
    10: "Oregon", 11: "Virginia", 12: "Maryland", 13: "Kentucky", 14: "Missouri",
    15: "Tennessee", 16: "Florida", 17: "Texas", 18: "Georgia", 19: "Arizona",
    20: "Nevada", 21: "California", 22: "Hawaii", 23: "Puerto Rico",
    24: "District of Columbia",
}
PAYMENT_BY_MOD6 = {0: "Cash", 1: "Credit Card", 2: "Debit Card", 3: "PayPal",
                   4: "Venmo", 5: "Bank Transfer"}
FREQUENCY_BY_MOD8 = {0: "Weekly", 1: "Bi-Weekly", 2: "Fortnightly", 3: "Quarterly",
                     4: "Annually", 5: "Monthly", 6: "Every 3 Months", 7: "Daily"}

# FIXED VALUES — the four group-mean ratios: (group, value, result)
RATIO_SPECS = [
    ("CATEGORY", "PURCHASE_AMOUNT_USD", "REL_SPEND_CAT_NEW"),
    ("CLIMATE_GROUP_NEW", "PURCHASE_AMOUNT_USD", "PURCHASE_AMT_REL_CLIMATE_NEW"),
    ("AGE_NEW", "PURCHASE_AMOUNT_USD", "REL_SPEND_AGE_NEW"),
    ("CLIMATE_GROUP_NEW", "FREQUENCY_VALUE_NEW", "REL_FREQ_CLIMATE_NEW"),
]
