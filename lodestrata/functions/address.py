"""Address expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOT, ROAD, GENERAL = "jibun", "road", "general"


def _sub(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for pattern, new in pairs:
        text = F.regexp_replace(text, pattern, new)
    return text


def split3(name: Column) -> Column:
    """struct<province,district,neighbourhood>: the first three words, null where there are fewer."""
    parts = F.split(F.trim(name), r"\s+")
    return F.struct(*[F.nullif(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("province", "district", "neighbourhood"))])


def road_or_lot(road: Column, lot: Column) -> Column:
    """The road address if it is not blank, else the lot address."""
    return F.coalesce(F.nullif(F.trim(road), F.lit("")), F.trim(lot))


# How the words of an address end or begin.
ROAD_NAME, LOT_NAME, OWN_NUMBER = r"(?:로|길|로[0-9]+가)$", r"(?:동|리|동[0-9]+가)$", r"^(.*[로길])([0-9]+(?:-[0-9]+)?)$"
NUMBER = r"^((?:지하)?[0-9]+(?:-[0-9]+)?)"
STOREY, ROOM = r"[0-9]층$|^전층$|^지[상하][0-9]*층?$|^B[0-9]+층?$", r"[0-9]호$|^[0-9]{2,}동$"
#: What a building, or a part of one, is called; of a housing notice's address only names with the first ones are cut.
HOUSES = "생활|빌"
INSIDE = f"{HOUSES}|빌딩|빌라|아파트|오피스텔|타워|센터|상가|단지|주택|관리동|관리실|본관|어린이집|유치원|학교|병원|약국|공원|체육관"
COMPANIES = "주식회사|유한회사|사단법인"


def _words(address: Column) -> Column:
    return F.filter(F.split(address, r"\s+"), lambda w: w != "")


def _unbracketed(address: Column, inside: str = "") -> Column:
    """Without parentheses (that hold ``inside``)."""
    return F.regexp_replace(address, rf"\([^)]*{inside}[^)]*\)" if inside else r"\([^)]*\)", " ")


def _joined(words: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(1), n), " ")


def parsed(words: Column) -> Column:
    """The places of an address, in order: array<struct<at,way,number,own>>.

    A place is a word that names a road or a lot's neighbourhood and has a number: the next
    word's, or with ``own`` the one it ends in itself. ``at`` is the name's offset.
    """

    def place(w: Column, i: Column) -> Column:
        following = F.nullif(F.regexp_extract(F.get(words, i + 1), NUMBER, 1), F.lit(""))
        way = F.when(w.rlike(ROAD_NAME), ROAD).when(w.rlike(LOT_NAME), LOT)
        found = lambda way, number, own: F.struct(i.alias("at"), way.alias("way"), number.alias("number"), F.lit(own).alias("own"))
        return F.when(w.rlike(OWN_NUMBER), found(F.lit(ROAD), F.regexp_extract(w, OWN_NUMBER, 2), True)).when(way.isNotNull() & following.isNotNull(), found(way, following, False))

    return F.filter(F.transform(words, place), lambda p: p.isNotNull())


def _rest(words: Column, first: Column, pattern: str) -> Column:
    """Number of words before the first one, from the offset ``first`` on, that fits a pattern; all if none does."""
    at = F.transform(words, lambda w, i: F.when((i >= first) & w.rlike(pattern), i))
    return F.coalesce(F.get(F.filter(at, lambda i: i.isNotNull()), F.lit(0)), F.size(words))


def housing(address: Column) -> Column:
    """An address of a housing notice as its words without brackets, up to a floor or the name of a house."""
    text = F.regexp_replace(F.regexp_replace(F.trim(_unbracketed(address)), r"\[[^\]]*\]$", ""), r"\s*~\s*|(?<=[0-9])\s+(?=층)", "")
    words = _words(text)
    return F.when(address.isNotNull(), _joined(words, _rest(words, F.lit(1), f"{STOREY}|^[가-힣]+(?:{HOUSES})")))


def geocodable(address: Column) -> Column:
    """The words of an address that a geocoder knows: through the number of its first place; without one through its first number, else all."""
    words = _words(F.regexp_replace(F.regexp_replace(_unbracketed(address), COMPANIES, ""), r"\s[0-9]+\s*~.*$", ""))
    first = F.get(parsed(words), F.lit(0))
    known = F.concat_ws(" ", _joined(words, first["at"] + 1), F.when(~first["own"], first["number"]))
    whole = F.array_join(words, " ")
    numbered = F.nullif(F.regexp_extract(whole, r"^([^0-9]*[0-9]+(?:-[0-9]+)?)", 1), F.lit(""))
    return F.when(address.isNotNull(), F.coalesce(F.when(first.isNotNull(), known), numbered, whole))


def subway(address: Column) -> Column:
    """The words of an address without a station's name before a parenthesis, and without parentheses."""
    marked = _words(F.regexp_replace(address, r"\([^)]*\)", "()"))
    kept = F.filter(marked, lambda w, i: ~((i > 0) & w.rlike(r"^[가-힣]+역\(\)$")))
    return F.array_join(_words(F.replace(F.array_join(kept, " "), F.lit("()"), F.lit(" "))), " ")


def park(address: Column) -> Column:
    """The words of an address without a park's name and the neighbourhood in parentheses."""
    bare = F.transform(_words(_unbracketed(address, "동")), lambda w, i: F.when(i > 0, F.regexp_replace(w, "^[가-힣]*공원[가-힣]*", "")).otherwise(w))
    return F.array_join(F.filter(bare, lambda w: w != ""), " ")


def kind(address: Column, general: bool = False) -> Column:
    """jibun (lot) if the address names a lot's place, road if it names a road's; ``general`` also tells addresses that end in a neighbourhood, and unknown ones, apart."""
    words = _words(address)
    ways = F.transform(parsed(words), lambda p: p["way"])
    out = F.when(F.coalesce(address == "", F.lit(True)), "unknown").when(F.array_contains(ways, LOT), LOT).when(F.array_contains(ways, ROAD), ROAD)
    if general:
        return out.when((F.size(words) >= 3) & F.element_at(words, -1).rlike(LOT_NAME), GENERAL).otherwise("unknown")
    return out.otherwise(LOT)


def candidates(raw: Column, clean: Column) -> Column:
    """Addresses to try in order: cleaned, raw, cleaned without numbers (road), raw without numbers (lot); no repeats."""
    bare = lambda a: F.trim(_sub(a, [(r"\d+[-\d]*", ""), (r"\s+", " ")]))
    tries = F.array(F.nullif(F.trim(clean), F.lit("")), raw, F.when(kind(clean) == ROAD, bare(clean)), F.when(kind(raw) == LOT, bare(raw)))
    return F.array_distinct(F.filter(tries, lambda a: a.isNotNull()))


def lot_numbers(address: Column) -> Column:
    """struct<main,sub> of the first number that stands behind a place's name; blank where missing."""
    places = F.filter(parsed(_words(address)), lambda p: ~p["own"])
    parts = F.split(F.get(places, F.lit(0))["number"], "-")
    part = lambda i: F.when(address.isNotNull(), F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
    return F.struct(part(0).alias("main"), part(1).alias("sub"))


def building_name(address: Column) -> Column:
    """The name after a comma in parentheses, without a general last word."""
    return F.regexp_replace(F.trim(F.regexp_extract(address, r"\([^,]+,\s*([^)]+)\)", 1)), r"\s+(주택|빌라|아파트|오피스텔|건물)$", "")


def looks_like_eligibility(address: Column) -> Column:
    """Whether an address field really holds conditions of eligibility."""
    # Words of such conditions.
    return F.coalesce(address.rlike("자격|대상|소득|무주택|신청|만\\s*\\d+세"), F.lit(False))


def bus_point(x: Column, y: Column) -> Column:
    """``x,y`` when both are numbers, else blank."""
    a, b = x.try_cast("double"), y.try_cast("double")
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(",", a.cast("string"), b.cast("string"))).otherwise("")


def facility(address: Column) -> Column:
    """An address of a facility up to what lies inside: a floor, a room or the name of a building behind the number of its first place.

    An address given twice counts once, and a number written onto a street's name is set apart.
    """
    text = F.regexp_replace(_unbracketed(address), r"(길)([0-9]+(?:-[0-9]+)?)(?=\s|$)", "$1 $2")
    words = _words(F.regexp_replace(text, r"(?<=[0-9])\s+(?=층|호)", ""))
    half = F.slice(words, F.lit(1), (F.size(words) / 2).cast("int"))
    once = F.when((F.size(half) > 1) & (F.concat(half, half) == words), half).otherwise(words)
    first = F.get(parsed(once), F.lit(0))
    kept = _joined(once, _rest(once, F.coalesce(first["at"] + F.when(first["own"], 1).otherwise(2), F.lit(1)), f"{STOREY}|{ROOM}|(?:{INSIDE})"))
    return F.regexp_replace(kept, r"[.,\-\s]+$", "")
