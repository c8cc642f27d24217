"""What each feed must deliver."""

from __future__ import annotations

from dataclasses import dataclass, field

from ledgerloom.functions import vocab as v


@dataclass(frozen=True)
class FeedContract:
    entity: str
    pk: str
    required: tuple[str, ...]
    non_null: tuple[str, ...]
    enums: dict[str, list[str]] = field(default_factory=dict)
    minimum_zero: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()


# Column lists, keys and domains of the landing schemas.
CONTRACTS = {
    c.entity: c
    for c in [
        FeedContract(
            "companies", "vendor_company_id",
            required=("vendor_company_id", "legal_name", "sector_taxonomy", "founded_date", "country"),
            non_null=("vendor_company_id", "legal_name", "country"),
            dates=("founded_date",),
        ),
        FeedContract(
            "funding_rounds", "vendor_round_id",
            required=("vendor_round_id", "vendor_company_id", "round_type", "announced_date", "amount_raised",
                      "currency", "instrument_type", "lead_investor_vendor_ids"),
            non_null=("vendor_round_id", "vendor_company_id", "round_type", "announced_date", "amount_raised",
                      "currency"),
            enums={"round_type": v.ROUND_TYPES, "currency": v.CURRENCIES, "instrument_type": v.INSTRUMENT_TYPES},
            minimum_zero=("amount_raised", "pre_money_valuation", "post_money_valuation"),
            dates=("announced_date",),
        ),
        FeedContract(
            "investors", "vendor_investor_id",
            required=("vendor_investor_id", "investor_type", "legal_name", "geographic_focus", "sector_focus",
                      "stage_focus"),
            non_null=("vendor_investor_id", "investor_type", "legal_name"),
            enums={"investor_type": v.INVESTOR_TYPES},
        ),
        FeedContract(
            "investments", "vendor_investment_id",
            required=("vendor_investment_id", "vendor_investor_id", "vendor_round_id", "vendor_company_id", "is_lead"),
            non_null=("vendor_investment_id", "vendor_investor_id", "vendor_round_id", "vendor_company_id"),
            enums={"exit_type": v.EXIT_TYPES},
            dates=("exit_date",),
        ),
        FeedContract(
            "people", "person_id",
            required=("person_id", "name", "current_affiliations", "historical_affiliations"),
            non_null=("person_id", "name"),
        ),
        FeedContract(
            "deals", "deal_id",
            required=("deal_id", "company_id", "stage", "stage_history"),
            non_null=("deal_id", "company_id", "stage"),
            enums={"stage": v.DEAL_STAGES},
        ),
        FeedContract(
            "documents", "document_id",
            required=("document_id", "document_type", "subject_company_ids", "created_date", "sensitivity_label"),
            non_null=("document_id", "document_type", "created_date"),
            enums={"document_type": v.DOCUMENT_TYPES, "sensitivity_label": v.SENSITIVITY_LABELS},
            dates=("created_date",),
        ),
    ]
}

# Two outside feeds, best source first, and the internal feed.
SOURCES = ("feed_a", "feed_b")
INTERNAL = "internal"
SHARED_ENTITIES = ("companies", "funding_rounds", "investors", "investments")
INTERNAL_ENTITIES = ("people", "deals", "documents")
FEEDS = [(s, e) for s in SOURCES for e in SHARED_ENTITIES] + [(INTERNAL, e) for e in INTERNAL_ENTITIES]

# entity -> (entity type in the identity map, canonical key)
ENTITY_KEYS = {
    "companies": ("company", "company_id"),
    "funding_rounds": ("funding_round", "round_id"),
    "investors": ("investor", "investor_id"),
    "investments": ("investment", "investment_id"),
}
# Columns delivered as JSON text, by entity.
JSON_COLUMNS = {
    "companies": ["sector_taxonomy"],
    "funding_rounds": ["lead_investor_vendor_ids"],
    "investors": ["geographic_focus", "sector_focus", "stage_focus"],
    "people": ["current_affiliations", "historical_affiliations", "education", "notable_prior_companies"],
    "deals": ["stage_history"],
    "documents": ["subject_company_ids", "subject_deal_ids"],
}
