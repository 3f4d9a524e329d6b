"""What drives extraction and decisions: fields with their groups, formats and queries, synonyms, criteria and settings.

All of it is data: the defaults below, or JSON files of the same shape (``load``). Tables of a few rows are made of it, which
plans broadcast.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Groups, fields (name, group, format, queries, overrides), synonyms and criteria, in their order.
GROUPS = ["dates_logistics", "commercial_legal", "product_specs"]
FIELDS = [
    ("Bid Number", "commercial_legal", "text", ["solicitation number", "RFP number", "bid number", "PORFP number", "reference number"], {}),
    ("Title", "commercial_legal", "text", ["title of the solicitation", "request for proposal title"], {}),
    ("Due Date", "dates_logistics", "datetime", ["submission deadline", "proposals due date and time", "closing date", "solicitation due"], {"sensitive": True}),
    ("Bid Submission Type", "dates_logistics", "text", ["how to submit proposal", "submission method", "submit electronically", "sealed bids"], {}),
    ("Term of Bid", "dates_logistics", "text", ["contract term", "length of contract", "renewal options", "initial term"], {"sensitive": True}),
    ("Pre Bid Meeting", "dates_logistics", "text", ["pre-bid meeting", "pre-proposal conference", "prebid conference date"], {"sensitive": True}),
    ("Delivery Date", "dates_logistics", "text", ["delivery date", "delivery within days of award", "shipping lead time"], {"sensitive": True}),
    ("Bid Bond Requirement", "commercial_legal", "text", ["bid bond", "bid security", "bid guarantee", "surety bond", "performance bond"], {"sensitive": True}),
    ("Payment Terms", "commercial_legal", "text", ["payment terms", "invoicing instructions", "net 30", "invoice submission"], {}),
    ("Any Additional Documentation Required", "commercial_legal", "list", ["required forms and affidavits", "documents to submit with proposal", "W9 form", "certificate of insurance"], {"evidence_k": 10}),
    ("MFG for Registration", "commercial_legal", "list", ["authorized reseller", "manufacturer authorization", "letter of authorization", "manufacturer name"], {}),
    ("Contract or Cooperative to use", "commercial_legal", "text", ["master contract", "cooperative contract", "piggyback", "contract vehicle"], {}),
    ("contact_info", "commercial_legal", "contact", ["buyer name email", "contact information email phone", "procurement officer contact", "point of contact for questions"], {"candidates": 30}),
    ("company_name", "commercial_legal", "text", ["issuing organization", "agency name", "school district"], {}),
    ("Model_no", "product_specs", "list", ["model number", "product model", "laptop model"], {}),
    ("Part_no", "product_specs", "list", ["part number", "SKU", "item number"], {"neighbours": 2, "candidates": 30, "id_patterns": [r"(?<![\w-])\d{3}-[A-Z0-9]{4}(?![\w-])"]}),
    ("Product", "product_specs", "list", ["products requested quantity", "required functionality product name qty", "pricing lines estimated quantity", "line item unit each"], {"evidence_k": 8, "neighbours": 3}),
    ("Product Specification", "product_specs", "list", ["processor memory storage display specifications", "minimum hardware requirements", "warranty"], {}),
    ("Installation", "product_specs", "text", ["installation services", "deployment imaging", "white glove services", "setup", "factory install"], {}),
    ("Bid Summary", "product_specs", "text", [], {"generated": True}),
]
SYNONYMS = [
    ["due date", "deadline", "closing date", "submission deadline", "proposals due", "proposal due", "bid opening"],
    ["bid bond", "bid security", "bid guarantee", "surety", "proposal guaranty"],
    ["pre-bid", "prebid", "pre-proposal", "prebid conference", "pre-proposal meeting"],
    ["payment terms", "payment", "net 30", "invoice", "invoicing"],
    ["term", "contract term", "length of contract", "renewal", "extension"],
    ["delivery", "delivery date", "shipping", "ship date", "lead time"],
    ["warranty", "warranties", "extended warranty"],
    ["affidavit", "affidavits", "certification", "forms"],
    ["contact", "buyer", "procurement officer", "point of contact", "poc"],
    ["installation", "imaging", "deployment", "white glove", "setup"],
    ["cooperative", "piggyback", "contract vehicle", "master contract"],
    ["manufacturer", "authorized reseller", "registration", "letter of authorization"],
]
CRITERIA = [("deadline", True), ("manufacturer_authorization", True), ("contract_vehicle", True), ("delivery", True), ("services", True), ("bonding", True), ("quantity", False), ("documents", False)]

FIELD_SCHEMA = "field string, field_pos int, grp string, kind string, is_list boolean, queries array<string>, sensitive boolean, generated boolean, evidence_k int, neighbours int, candidates int, id_patterns array<string>"


@dataclass(frozen=True)
class Settings:
    """Constants of the plans, with their defaults; secrets are no settings."""

    target_tokens: int = 500
    max_tokens: int = 650
    min_tokens: int = 80
    overlap_tokens: int = 80
    retrieve_k: int = 30
    rrf_k: int = 60
    sparse_weight: float = 1.0
    identifier_weight: float = 2.0
    per_query_k: int = 5
    per_field_k: int = 5
    neighbour_seeds: int = 2
    neighbour_window: int = 1
    rerank_candidates: int = 12
    retries: int = 2
    cache_similarity: float = 0.95
    cache_rows: int = 500
    min_days_to_prepare: int = 7
    synonyms: list[list[str]] = field(default_factory=lambda: SYNONYMS)

    def with_values(self, values: dict) -> Settings:
        """These settings with other values; an unknown name is an error."""
        unknown = set(values) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **values)


def load(path: str | None) -> dict:
    """A JSON file of settings, fields, groups or criteria; nothing without a path."""
    return json.loads(Path(path).read_text()) if path else {}


def settings(path: str | None = None) -> Settings:
    return Settings().with_values(load(path).get("settings", {}))


def registry(spark: SparkSession, entries: list | None = None, groups: list[str] | None = None) -> DataFrame:
    """The table of fields in registry order. A field of an unknown group is an error."""
    entries = FIELDS if entries is None else entries
    unknown = {e[1] for e in entries} - set(GROUPS if groups is None else groups)
    if unknown:
        raise ValueError(f"unknown groups: {sorted(unknown)}")
    rows = [(name, i, group, kind, kind == "list", queries, more.get("sensitive", False), more.get("generated", False), more.get("evidence_k"), more.get("neighbours"), more.get("candidates"), more.get("id_patterns", [])) for i, (name, group, kind, queries, more) in enumerate(entries)]
    return spark.createDataFrame(rows, FIELD_SCHEMA)


def extractable(fields_: DataFrame) -> DataFrame:
    return fields_.where("not generated")


def by_group(fields_: DataFrame) -> DataFrame:
    """(grp, fields): the extracted fields of each group, in order."""
    one = F.array_sort(F.collect_list(F.struct("field_pos", "field")))
    return extractable(fields_).groupBy("grp").agg(F.transform(one, lambda x: x["field"]).alias("fields"))


def criteria(spark: SparkSession, entries: list | None = None) -> DataFrame:
    return spark.createDataFrame([(i, c, m) for i, (c, m) in enumerate(CRITERIA if entries is None else entries)], "pos int, id string, must_have boolean")


def as_dict(values: Settings) -> dict:
    return asdict(values)
