"""Names for RFM codes: three digits, one score each for recency, frequency and money (4 is the worst score)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segment -> codes. The first segment that lists a code owns it; every other code is "Lost clients".
SEGMENTS = {
    "Key clients": ["123", "133", "143", "223", "233", "243", "323", "333", "343"],
    "Prospective clients": ["112", "122", "113", "213", "214", "232", "312"],
    "One-time donors": ["111", "112", "121", "131", "211", "221", "311"],
    "Rarely active": ["141", "142", "144", "241", "242", "244", "341", "342", "344", "444"],
    "Moderately active": ["114", "124", "132", "213", "222", "224", "234", "324"],
    "Growth potential clients": ["213", "222", "231", "312", "323"],
    "Highly active": ["221", "311", "321", "322", "331"],
}
OTHER_SEGMENT = "Lost clients"

# Wording per score.
RECENCY_WORDS = {"1": "Inactive", "2": "Relatively active", "3": "Active"}
FREQUENCY_WORDS = {"1": "low", "2": "medium", "3": "high", "4": "extremely low"}
MONEY_WORDS = {"1": "small", "2": "medium", "3": "high", "4": "extremely small"}
CHURNED = "Churned clients with extremely low transfer frequency and extremely small donation amounts"


def _case(pairs: list[tuple[Column, str]]) -> Column:
    (condition, text), *others = pairs
    chosen = F.when(condition, text)
    for condition, text in others:
        chosen = chosen.when(condition, text)
    return chosen


def segment_name(code: Column) -> Column:
    return _case([(code.isin(codes), name) for name, codes in SEGMENTS.items()]).otherwise(OTHER_SEGMENT)


def segment_description(code: Column) -> Column:
    def word(position: int, words: dict[str, str]) -> Column:
        return _case([(F.substring(code, position, 1) == score, text) for score, text in words.items()])

    text = F.concat(
        word(1, RECENCY_WORDS),
        F.lit(" clients with "),
        word(2, FREQUENCY_WORDS),
        F.lit(" transfer frequency and "),
        word(3, MONEY_WORDS),
        F.lit(" donation amounts"),
    )
    return F.coalesce(text, F.lit(CHURNED))
