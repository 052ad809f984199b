"""Default ordered cleaning rules for German user comments (F2).

Each rule is ``(kind, find, replace)``; ``literal`` = substring replace,
``regex`` = regular-expression replace, ``urls`` = the URL cleaner (F1).
The list is data: callers can pass their own list (or read one from a
table with :func:`rules_from_frame`).  Two documented deviations from the
reference: the team strings ``bvb`` and ``FCB`` are two rules (the
reference's list misses a comma and joins them), and the broken-euro form
after ``Milliarden`` maps to ``Milliarden Euro``.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Must equal the reference's rules for equal results.
# Stages in order: names -> roles, "aber", numbers, amounts, broken euro
# signs, spouse phrases, "xcx" markers, coalition nicknames, URLs, hyphens,
# parties, teams, abbreviations and mojibake, removals.
DEFAULT_RULES = [
    ("literal", "Angela Merkel", "Kanzlerin"),
    ("literal", "Donald Trump", "Präsident"),
    ("literal", "Merkel", "Kanzlerin"),
    ("literal", "Trump", "Präsident"),
    ("regex", "[Aa]+ber", "aber"),
    ("literal", "<NUM>", "5"),
    ("regex", r"5 [Mm]rd\.?", "5 Milliarden"),
    ("regex", r"5 [Mm]io\.?", "5 Millionen"),
    ("literal", r"5\\xc5\\x5", "5 Euro"),
    ("literal", r"5 \\xc5\\x5", "5 Euro"),
    ("literal", r"5T\\xc5\\x5", "5 Euro"),
    ("literal", r"5T \\xc5\\x5", "5 Euro"),
    ("literal", r"5M\\xc5\\x5", "5 Euro"),
    ("literal", r"5M \\xc5\\x5", "5 Euro"),
    ("literal", r"Millionen \\xc5\\x5", "Millionen Euro"),
    ("literal", r"Milliarden \\xc5\\x5", "Milliarden Euro"),
    ("regex", "[MSD]eine Frau ", "Ehefrau"),
    ("regex", " [msd]eine Frau", " Ehefrau"),
    ("regex", "[MSD]ein Mann ", "Ehemann"),
    ("regex", " [msd]ein Mann", " Ehemann"),
    ("literal", "Ex-Mann", "Ehemann"),
    ("literal", "Ex-Männer", "Ehemänner"),
    ("literal", "Ex-Frau", "Ehefrau"),
    ("literal", "Ihre Frauen ", "Ehefrau"),
    ("literal", " ihre Frauen", " Ehefrau"),
    ("literal", "Ihre Männer ", "Ehemann"),
    ("literal", " ihre Männer", " Ehemann"),
    ("literal", "Ihre Frau ", "Ehefrau"),
    ("literal", " ihre Frau", " Ehefrau"),
    ("literal", "Ihr Mann ", "Ehemann"),
    ("literal", " ihr Mann", " Ehemann"),
    ("literal", "xcx", ""),
    ("literal", "Xcx", ""),
    ("literal", "XCX", ""),
    ("literal", "GroKo", "Koalition"),
    ("literal", "groko", "Koalition"),
    ("literal", "Groko", "Koalition"),
    ("urls", "", ""),
    ("literal", "-", " "),
    # parties -> "Partei"
    ("literal", "CDU", "Partei"), ("literal", "Cdu", "Partei"), ("literal", "cdu", "Partei"),
    ("literal", "CSU", "Partei"), ("literal", "Csu", "Partei"), ("literal", "csu", "Partei"),
    ("literal", "AFD", "Partei"), ("literal", "Afd", "Partei"), ("literal", "AfD", "Partei"),
    ("literal", "afd", "Partei"),
    ("literal", "SPD", "Partei"), ("literal", "Spd", "Partei"), ("literal", "spd", "Partei"),
    ("literal", "Grünen", "Partei"), ("literal", "Bündnis90", "Partei"),
    ("literal", "Piratenpartei", "Partei"),
    ("literal", "FDP", "Partei"), ("literal", "Fdp", "Partei"), ("literal", "fdp", "Partei"),
    ("literal", "NPD", "Partei"), ("literal", "Npd", "Partei"), ("literal", "npd", "Partei"),
    ("literal", "ÖDP", "Partei"), ("literal", "Ödp", "Partei"), ("literal", "ödp", "Partei"),
    ("literal", "FPÖ", "Partei"), ("literal", "Fpö", "Partei"), ("literal", "fpö", "Partei"),
    ("literal", "SPÖ", "Partei"), ("literal", "Spö", "Partei"), ("literal", "spö", "Partei"),
    ("literal", "ÖVP", "Partei"), ("literal", "Övp", "Partei"), ("literal", "övp", "Partei"),
    ("literal", "die Linke", "Partei"),
    ("literal", "Republikaner", "Partei"), ("literal", "Republicans", "Partei"),
    ("literal", "republikaner", "Partei"), ("literal", "republicans", "Partei"),
    ("literal", "Demokraten", "Partei"), ("literal", "Democrats", "Partei"),
    ("literal", "demokraten", "Partei"), ("literal", "democrats", "Partei"),
    # teams -> "Verein"
    ("literal", "Borussia", "Verein"), ("literal", "borussia", "Verein"),
    ("literal", "borussen", "Verein"), ("literal", "Borussen", "Verein"),
    ("literal", "BVB", "Verein"), ("literal", "bvb", "Verein"), ("literal", "FCB", "Verein"),
    ("literal", "FC Bayern", "Verein"), ("literal", "fc bayern", "Verein"),
    ("literal", "fcb", "Verein"),
    ("literal", "Werder Bremen", "Verein"), ("literal", "Werder", "Verein"),
    ("literal", "werder", "Verein"),
    ("literal", " TSV", "Verein"), ("literal", " tsv", "Verein"),
    ("literal", "Eintracht", "Verein"), ("literal", "VfB", "Verein"),
    ("literal", "Hertha BSC", "Verein"), ("literal", "hertha bsc", "Verein"),
    ("literal", "hertha", "Verein"),
    ("literal", "Arminia Bielefeld", "Verein"), ("literal", "EffZee Köln", "Verein"),
    # abbreviations and mojibake
    ("literal", "FIFA", "Fußball Verband"), ("literal", "fifa", "Fußball Verband"),
    ("literal", "DFB", "Fußball Verband"), ("literal", "dfb", "Fußball Verband"),
    ("literal", "BuLi", "Bundesliga"), ("literal", "IOC", "Olympisches Komitee"),
    ("literal", "BuLa", "Bundesland"), ("literal", "NRW", "Bundesland"),
    ("literal", "kmh", "Geschwindigkeit"), ("literal", "km/h", "Geschwindigkeit"),
    ("literal", "5km", "5 Kilometer"), ("literal", "5 km", "5 Kilometer"),
    ("literal", "5 Km", "5 Kilometer"),
    ("literal", "kwh", "Kilowatt"), ("literal", "kWh", "Kilowatt"),
    ("literal", "kcal", "Kalorien"), ("literal", " OS ", " Betriebssystem "),
    ("literal", "5kg", "5 Kilogramm"), ("literal", "5 kg", "5 Kilogramm"),
    ("literal", "LKA", "Kriminalamt"), ("literal", "BKA", "Kriminalamt"),
    ("literal", "PLZ", "Postleitzahl"), ("literal", "Tesla", "Auto"),
    ("literal", "5EUR", "5 Euro"), ("literal", "5 EUR", "5 Euro"), ("literal", "5 Eur", "5 Euro"),
    ("literal", " EUR ", " Euro "), ("literal", " EUR.", " Euro."), ("literal", " EUR,", " Euro,"),
    ("literal", "5mm", "5 Milimeter"), ("literal", "5 mm", "5 Milimeter"),
    ("literal", "5 ltr", "5 Liter"), ("literal", "5 Ltr", "5 Liter"),
    ("literal", "D Mark", "Euro"), ("literal", "D-Mark", "Euro"), ("literal", "DMark", "Euro"),
    ("literal", "SUV", "Auto"), ("literal", " IT ", " Informationstechnologie "),
    ("literal", "NGO", "Organisation"),
    ("literal", "MWST", "Mehrwertsteuer"), ("literal", "mwst", "Mehrwertsteuer"),
    ("literal", "MwSt", "Mehrwertsteuer"),
    ("literal", "den Nagel auf den Kopf", "richtig"),
    ("literal", "ZDF", "Fernsehsender"), ("literal", "ARD", "Fernsehsender"),
    ("literal", "RTL", "Fernsehsender"),
    ("literal", "Pkw", "Auto"), ("literal", "Lkw", "Auto"), ("literal", "PKW", "Auto"),
    ("literal", "LKW", "Auto"),
    ("literal", "Know-How", "Wissen"), ("literal", "Knowhow", "Wissen"),
    ("literal", "ã¤", "ä"), ("literal", "ã¼", "ü"), ("literal", "ã¶", "ö"),
    ("literal", "ã\x9f", "ß"), ("literal", "ã\\x9f", "ß"),
    ("literal", "Ã\x9c", "Ü"), ("literal", "Ã\\x9c", "Ü"),
    ("literal", "Ã¼", "Ü"), ("literal", "Ã¶", "Ö"),
    ("literal", "Ã\x96", "Ö"), ("literal", "Ã\\x96", "Ö"),
    ("literal", "Ã\\x84", "Ä"), ("literal", "Ã\x84", "Ä"),
    # removals
    ("literal", "&gt,", ""),
]
# ---------------------------------------------------------------------------


def rules_from_frame(df):
    """Rule list from a table ``(ord, kind, find, replace)`` (small, so it
    is read to the driver to build one Column expression)."""
    rows = df.orderBy("ord").collect()
    return [(r["kind"], r["find"], r["replace"]) for r in rows]


def sql_clean_expr(col: str, rules=None, whole_url: bool = False) -> str:
    """The DuckDB form of the same fold (used by the oracle)."""
    from lexmesh.functions.text import ANCHOR_PATTERN, URL_PATTERN, URL_PATTERN_WHOLE

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    e = col
    for kind, find, repl in (rules if rules is not None else DEFAULT_RULES):
        if kind == "literal":
            e = f"replace({e}, {q(find)}, {q(repl)})"
        elif kind == "regex":
            e = f"regexp_replace({e}, {q(find)}, {q(repl)}, 'g')"
        elif kind == "urls":
            e = sql_remove_urls(e, whole_url)
    return e


def sql_remove_urls(e: str, whole_url: bool = False) -> str:
    from lexmesh.functions.text import ANCHOR_PATTERN, URL_PATTERN, URL_PATTERN_WHOLE

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"
    e = f"regexp_replace({e}, {q(r'^\.{3}')}, '', 'g')"
    e = f"regexp_replace({e}, {q(r'\.{3}')}, '.', 'g')"
    e = f"regexp_replace({e}, {q(ANCHOR_PATTERN)}, '', 'g')"
    e = f"regexp_replace({e}, {q(URL_PATTERN_WHOLE if whole_url else URL_PATTERN)}, '<URL>', 'g')"
    return f"replace({e}, '</a>', '')"
