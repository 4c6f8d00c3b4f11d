"""Edges and labels of bands, and the rules that name segments. Plans and SQL are made from these lists."""

# Fixed values: (upper edge, label) of each band in order, and the label beyond the last edge.
AGE = (((30, "18-29"), (40, "30-39"), (50, "40-49"), (60, "50-59")), "60+")
TRANSACTION_COUNT = (((20, "1-20"), (50, "21-50"), (100, "51-100"), (150, "101-150")), "150+")
RESOLUTION_HOURS = (((12, "0-12 Hours"), (24, "12-24 Hours"), (48, "24-48 Hours"), (72, "48-72 Hours")), "Over 72 Hours")
UTILIZATION = (((0.1, "Low (< 10%)"), (0.4, "Medium (10-40%)"), (0.7, "High (40-70%)")), "Very High (70%+)")
SPEND_TREND = (
    ((0.5, "Significant Decrease (<50%)"), (0.9, "Moderate Decrease (50-90%)"), (1.1, "Stable (90-110%)")),
    "Increase (>110%)",
)

# Labels of tiles, first tile first.
PARETO = ("Top 20%", "21-40%", "41-60%", "61-80%", "Bottom 20%")
AMOUNT_QUARTILES = ("Q1 (Lowest 25%)", "Q2 (25-50%)", "Q3 (50-75%)", "Q4 (Highest 25%)")
VALUE_TIERS = ("High Value (Top 33%)", "Medium Value (Middle 33%)", "Low Value (Bottom 33%)")

# RFM segments; the first one counts whose least and greatest scores (recency, frequency, monetary) hold.
RFM = (
    ("1. Champions", (4, 5), (4, 5), (4, 5)),
    ("2. Loyal Customers", (3, 5), (3, 5), (3, 5)),
    ("3. Recent Customers", (4, 5), (1, 2), (1, 5)),
    ("4. At Risk (High Engagement)", (1, 2), (4, 5), (1, 5)),
    ("5. Cannot Lose Them", (1, 2), (1, 2), (4, 5)),
    ("6. Lost / Hibernating", (1, 2), (1, 2), (1, 2)),
)
RFM_OTHER = "7. Average"
