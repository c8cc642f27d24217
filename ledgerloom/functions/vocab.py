"""Fixed values. Results depend on these exact words, numbers and formats."""

# Tolerances: a gap must be strictly larger to count as a conflict.
AMOUNT_TOLERANCE = 0.05
DAYS_TOLERANCE = 30

# Envelope bounds.
OPEN_END = "9999-12-31"
GENESIS = "1900-01-01"

# Row status after reconciliation.
CLEAN = "clean"
RESOLVED = "conflict_resolved"
FLAGGED = "conflict_flagged"
ALLOWED_STATUS = [CLEAN, RESOLVED, FLAGGED]

# Conflict log vocabulary.
VALUE_CONFLICT = "value_disagreement"
TEMPORAL_CONFLICT = "temporal_disagreement"
EXISTENCE_CONFLICT = "existence_disagreement"
AUTO_RESOLVED = "auto_resolved"
FLAGGED_FOR_REVIEW = "flagged_for_review"
RESOLVER = "stage_b"
GENUINE = "genuine_dispute"
COVERAGE_GAP = "coverage_gap"

# Lineage columns every feed must carry, and the full set the stamp writes.
LINEAGE_REQUIRED = ["_record_id", "_source_system", "_ingestion_ts", "_batch_id", "_is_synthetic"]
LINEAGE_COLUMNS = [
    "_record_id", "_source_system", "_source_file", "_ingestion_ts", "_batch_id", "_data_version", "_is_synthetic",
]

# Sector tags by group.
SECTOR_GROUPS = {
    "Information Technology": ["SaaS", "AI/ML", "Cybersecurity", "DevTools", "Data Infrastructure", "Fintech Infra"],
    "Healthcare": ["Digital Health", "Biotech", "Medical Devices", "Diagnostics", "Genomics"],
    "Financials": ["Fintech", "Payments", "Lending", "InsurTech", "WealthTech"],
    "Consumer": ["Consumer Apps", "E-commerce", "Marketplace", "Food & Bev", "Gaming"],
    "Industrials": ["Robotics", "Supply Chain", "Manufacturing Tech", "Logistics"],
    "Energy": ["Energy Storage", "Grid Tech", "Oil & Gas Tech"],
    "Climate": ["Carbon Capture", "Clean Energy", "Sustainability"],
    "Mobility": ["AV/Autonomy", "EV", "Micromobility", "Fleet"],
}

# Enumerations of the feed schemas.
ROUND_TYPES = ["Pre-Seed", "Seed", "Series A", "Series B", "Series C", "Series D", "Series E", "Bridge", "Growth"]
INSTRUMENT_TYPES = ["Equity", "Convertible Note", "SAFE"]
CURRENCIES = ["USD", "EUR", "GBP"]
INVESTOR_TYPES = [
    "vc_fund", "pe_fund", "corporate_vc", "family_office", "sovereign_fund", "angel", "accelerator", "strategic",
]
STAGE_FOCUS = ["Pre-Seed", "Seed", "Early", "Growth", "Late"]
EXIT_TYPES = ["acquisition", "ipo", "secondary_sale", "write_off"]
DEAL_STAGES = [
    "sourcing", "screening", "due_diligence", "ic_review", "closing", "closed_won", "closed_lost", "passed",
]
DOCUMENT_TYPES = ["ic_memo", "dd_report", "news_article", "transcript", "vendor_report", "analyst_note"]
SENSITIVITY_LABELS = ["Public", "Internal", "Confidential", "Highly Confidential"]

# Fund letters: at most this many trailing quarter ends, two to four holdings named in each.
LETTER_QUARTERS = 8
HIGHLIGHTS_MIN, HIGHLIGHTS_MAX = 2, 4

# Document wording.
LETTER_TEXT = (
    "Quarterly letter -- %s, quarter ended %s. The fund's portfolio spans %s companies. "
    "This quarter's highlights include %s. Full holdings detail is available on request."
)
CALL_TEXT = "Capital call notice -- %s calls %s %s for its participation in %s's %s round, closing %s."
MEMO_TEXT = "Memo -- %s realised its position in %s via %s, effective %s, returning %s."
UNDISCLOSED_MULTIPLE = "an undisclosed multiple"
ENVELOPE_TEXT = "Document ID: %s\nType: %s\nFund (investor_id): %s\nEffective date: %s\n\n%s\n"

# The same wording as patterns, with the groups the extraction reads.
LETTER_PATTERN = (
    r"Quarterly letter -- (.+?), quarter ended (\d{4}-\d{2}-\d{2})\. "
    r"The fund's portfolio spans (\d+) companies\."
)
CALL_PATTERN = (
    r"Capital call notice -- (.+?) calls ([\d,]+\.\d{2}) (\w+) "
    r"for its participation in (.+?)'s (.+?) round, closing (\d{4}-\d{2}-\d{2})\."
)
MEMO_PATTERN = (
    r"Memo -- (.+?) realised its position in (.+?) via (.+?), "
    r"effective (\d{4}-\d{2}-\d{2}), returning ([\d.]+)x cost\."
)
NUMBER_PATTERN = r"-?\d[\d,]*\.?\d*"

# Names and details of the checks, in the order of the reports.
CHECK_ONE_CURRENT = "envelope one-current-per-key [%s]"
CHECK_NO_NULLS = "envelope no-nulls [%s]"
CHECK_ORDERED = "envelope valid_from<=valid_to [%s]"
CHECK_ROW_COUNT = "rowcount reconcile [%s]"
CHECK_STATUS = "status domain [%s]"
CHECK_TEMPORAL = "temporal effective<=ingestion [%s]"
CHECK_FACT_COMPANY = "FK fact_investment.company_sk -> dim_company"
CHECK_FACT_INVESTOR = "FK fact_investment.investor_sk -> dim_investor"
CHECK_PIT_COMPANY = "no unmatched point-in-time company join"
CHECK_PIT_INVESTOR = "no unmatched point-in-time investor join"
CHECK_FACT_ROWS = "rowcount reconcile fact_investment vs conformed_investments"
DETAIL_REFERENCE = "%s unresolved of %s distinct"
DETAIL_ONE_CURRENT = "%s keys >1 current; %s/%s keys have a current row"
DETAIL_NO_NULLS = "%s null envelope rows"
DETAIL_ORDERED = "%s inverted ranges"
DETAIL_ROW_COUNT = "%s distinct keys vs %s expected"
DETAIL_STATUS = "%s rows outside allowed set, %s null"
DETAIL_TEMPORAL = "%s rows effective > ingestion (disclosure-lag expected)"
DETAIL_PIT_COMPANY = "%s fact rows with no matching dim_company version"
DETAIL_PIT_INVESTOR = "%s fact rows with no matching dim_investor version"
DETAIL_FACT_ROWS = "%s fact rows vs %s current conformed investments"
DETAIL_DIM_CURRENT = "%s keys with >1 current row"
