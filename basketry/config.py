"""Fixed values and parameters of the visit features.

Everything that depends on the data set (names, thresholds, groups) is a field of ``FeatureConfig``; the
module constants hold the values for the original retail data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values ---------------------------------------------------------------------------------------------
WEEKDAYS = {"Monday": 1, "Tuesday": 2, "Wednesday": 3, "Thursday": 4, "Friday": 5, "Saturday": 6, "Sunday": 7}
LAST_WORKDAY = 4  # Friday, Saturday and Sunday are the weekend

OTHER_CLASS = 999
TRIP_TYPES = [
    3, 4, 5, 6, 7, 8, 9, 12, 14, 15, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37,
    38, 39, 40, 41, 42, 43, 44, 999,
]
EMPTY_VISIT_P = 0.75  # probability of OTHER_CLASS for a visit without any department

RETURN_VISIT = -10
PURCHASE_VISIT = 10

PARTIAL_TEST_ROWS = 22_757
PARTIAL_TRAIN_ROWS = 1_065_201

MISSING_DEPARTMENT = "NA"
MISSING_FINELINE = 12345
MISSING_UPC = 123
MISSING_ID = -1  # used by the profiling queries

EXCLUDED_DEPARTMENT = "PHARMACY RX"
FINANCIAL_DEPARTMENT = "FINANCIAL SERVICES"
MERGED_DEPARTMENTS = {"HEALTH AND BEAUTY AIDS": "BEAUTY"}

SHARE_FINELINE_COUNT = 500
FINELINE_COUNT = 1000
PROFILE_FINELINE_COUNT = 2000
UPC_COUNT = 500

DEPARTMENT_GROUPS = {
    "financial_visit": ["FINANCIAL SERVICES"],
    "medl_visit": ["PHARMACY RX", "PHARMACY OTC"],
    "hw_visit": ["HARDWARE", "PAINT AND ACCESSORIES"],
    "garden_visit": ["LAWN AND GARDEN", "HORTICULTURE AND ACCESS"],
    "sport_visit": ["SPORTING GOODS"],
    "wireless_visit": ["WIRELESS"],
    "infant_visit": ["INFANT CONSUMABLE HARDLINES", "INFANT APPAREL"],
    "household_visit": ["HOUSEHOLD CHEMICALS/SUPP"],
    "pets_visit": ["PETS AND SUPPLIES"],
    "pharma_otc_visit": ["PHARMACY OTC"],
    "wine_smoke_visit": ["LIQUOR,WINE,BEER", "CANDY, TOBACCO, COOKIES"],
    "celebration_visit": ["CELEBRATION"],
    "toy_visit": ["TOYS"],
    "electronics_visit": ["ELECTRONICS"],
    "auto_visit": ["AUTOMOTIVE"],
}

SHARE_DEPARTMENTS = [
    "SERVICE DELI",
    "GROCERY DRY GOODS",
    "PRODUCE",
    "FROZEN FOODS",
    "DSD GROCERY",
    "MEAT - FRESH & FROZEN",
    "COMM BREAD",
    "DAIRY",
    "BAKERY",
    "PRE PACKED DELI",
    "IMPULSE MERCHANDISE",
    "PERSONAL CARE",
    "HOUSEHOLD PAPER GOODS",
    "BEAUTY",
    "MENS WEAR",
    "LADIESWEAR",
    "CELEBRATION",
    "COOK AND DINE",
    "OFFICE SUPPLIES",
    "HOME MANAGEMENT",
    "SHOES",
    "FABRICS AND CRAFTS",
    "BATH AND SHOWER",
    "GIRLS WEAR, 4-6X  AND 7-14",
    "HOME DECOR",
    "BOYS WEAR",
    "JEWELRY AND SUNGLASSES",
    "SLEEPWEAR/FOUNDATIONS",
    "BEDDING",
    "BRAS & SHAPEWEAR",
    "MEDIA AND GAMING",
    "SEAFOOD",
    "ACCESSORIES",
    "BOOKS AND MAGAZINES",
    "1-HR PHOTO",
    "PLAYERS AND ELECTRONICS",
]

GROCERY_DEPARTMENTS = [
    "GROCERY DRY GOODS",
    "DSD GROCERY",
    "DAIRY",
    "PRODUCE",
    "HOUSEHOLD CHEMICALS/SUPP",
    "HOUSEHOLD PAPER GOODS",
    "PERSONAL CARE",
    "FROZEN FOODS",
    "COMM BREAD",
    "PHARMACY OTC",
    "PRE PACKED DELI",
    "IMPULSE MERCHANDISE",
    "MEAT - FRESH & FROZEN",
    "PETS AND SUPPLIES",
    "BEAUTY",
    "CANDY, TOBACCO, COOKIES",
    "INFANT CONSUMABLE HARDLINES",
    "SERVICE DELI",
    "BAKERY",
    "COOK AND DINE",
    "LIQUOR,WINE,BEER",
    "CELEBRATION",
    "SEAFOOD",
]
# End of fixed values --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureConfig:
    """Parameters of the visit feature matrix.

    ``share_departments`` limits the single-department shares to a list; ``None`` takes every department of
    the fitted vocabulary.
    """

    excluded_department: str = EXCLUDED_DEPARTMENT
    merges: dict[str, str] = field(default_factory=lambda: dict(MERGED_DEPARTMENTS))
    groups: dict[str, list[str]] = field(default_factory=lambda: dict(DEPARTMENT_GROUPS))
    share_departments: list[str] | None = field(default_factory=lambda: list(SHARE_DEPARTMENTS))
    fineline_count: int = FINELINE_COUNT
    upc_count: int = UPC_COUNT
