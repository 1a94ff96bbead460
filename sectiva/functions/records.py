"""Semi-structured records: fields, age, sex, narrative, codes, cleaning, integrity checks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sectiva.functions.text import first_group, flag, found, let, negation_count, strip, text

# Names and patterns of the fields of a record.
NARRATIVE_FIELDS = ("Жалобы", "Анамнез", "Объективный статус")
DIAGNOSIS_FIELDS = ("Диагноз", "Основное заболевание", "Заключение", "Сопутствующие заболевания", "Осложнения")
CODE = r"\s*:\s*([A-Z]\d{2}(?:\.\d{1,2})?)"
FREE_AGE = r"(?U)(\d{1,3})\s*[- ]?\s*(лет|года|год)\b"
LAB_LINE = r"Показатель:[^\n]*"
BLANK_RUNS = r"(?U)\s*\n\s*(?:\n\s*)+"
PRESENCE = {
    "icd": r"(?iU)Код\s*МКБ-10\s*:",
    "sex": r"(?iU)Пол\s*:",
    "age": r"(?iU)Возраст\s*:",
    "date": r"(?iU)Дата\s+приема\s*:",
    "complaints": r"(?iU)Жалобы\s*:",
    "anamnesis": r"(?iU)Анамнез\s*:",
    "status": r"(?iU)Объективный\s+статус\s*:",
}
MOJIBAKE = r"[ÐÑ][\x{80}-\x{bf}]|Ã[\x{80}-\x{bf}]"
LEXICONS = {
    "negation": r"(?iU)\b(не|нет|без|отрицает|не\s+выявлен\w*|не\s+отмечает\w*|отсутств\w+|не\s+отягощен\w*)\b",
    "age": r"(?iU)(до\s+\d+\s*лет|старше\s+\d+|у\s+дет\w+|у\s+взрослых|новорожд\w+|подростк\w+|пожил\w+)",
    "gender": r"(?iU)(женщин\w*|мужчин\w*|беременн\w*|кормящ\w*|лактац\w*)",
    "severity": r"(?iU)(тяжёл\w*|тяжел\w*|лёгк\w*|легк\w*|среднетяжёл\w*|степен\w*|стади\w*)",
}
MISSING = "NA"


def field(c: Column, name: str) -> Column:
    """First value behind ``name:``; the blanks after the colon may cross a line.  Null if absent."""
    return strip(first_group(text(c), rf"(?U){re.escape(name)}\s*:\s*([^\n]+)"))


def age(c: Column) -> Column:
    """Age from its field, else from a phrase in years; null if neither states one."""
    structured = first_group(field(c, "Возраст"), r"(?U)\d{1,3}", 0)
    return F.coalesce(structured, first_group(text(c), FREE_AGE)).cast("double")


def gender(c: Column) -> Column:
    """F or M from the field alone, never guessed."""
    low = F.lower(field(c, "Пол"))
    return F.when(low.startswith("ж"), F.lit("F")).when(low.startswith("м"), F.lit("M"))


def narrative(c: Column) -> Column:
    """The narrative sections joined, each up to the next capitalised heading; the whole text if there is none."""
    section = lambda name: strip(first_group(text(c), rf"(?sU){re.escape(name)}\s*:\s*(.+?)(?=\n[А-ЯЁ][^\n:]{{0,40}}:|\z)"))
    return let(F.array_compact(F.array(*map(section, NARRATIVE_FIELDS))), lambda x: F.when(F.size(x) > 0, F.array_join(x, " ")).otherwise(text(c)))


def record_fields(c: Column) -> dict[str, Column]:
    """Sex, age, header flag, negations, length and narrative of a record."""
    return {
        "gender_raw": gender(c), "age": age(c), "has_structured_header": flag(text(c).rlike(r"(?U)Пол\s*:")),
        "negation_count": negation_count(c), "protocol_len": F.length(text(c)), "narrative_text": narrative(c),
    }


def icd_code(c: Column) -> Column:
    """Code behind its own heading, else behind the diagnosis; NA if none."""
    return F.coalesce(first_group(text(c), "(?U)Код МКБ-10" + CODE), first_group(text(c), "(?U)Диагноз" + CODE), F.lit(MISSING))


def icd_category(code: Column) -> Column:
    return F.when(code == MISSING, code).otherwise(F.left(code, F.lit(3)))


def diagnosis_text(c: Column) -> Column:
    """All diagnosis fields joined, by field and then place."""
    each = [F.regexp_extract_all(text(c), F.lit(rf"(?U){re.escape(name)}\s*:\s*([^\n]+)"), F.lit(1)) for name in DIAGNOSIS_FIELDS]
    return F.array_join(F.transform(F.flatten(F.array(*each)), strip), " ")


def clean_record(c: Column) -> Column:
    """Without laboratory lines, blank runs collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(text(c), LAB_LINE, ""), BLANK_RUNS, "\n"))


def lab_share(c: Column) -> Column:
    """Share of a record's characters in laboratory lines."""
    n = F.aggregate(F.transform(found(text(c), LAB_LINE), lambda x: F.length(x)), F.lit(0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(n, F.length(text(c))), F.lit(0.0))


def presence(c: Column) -> dict[str, Column]:
    """Which of the seven fields a record has."""
    return {f"has_{k}": flag(text(c).rlike(p)) for k, p in PRESENCE.items()}


def lexicon_flags(c: Column) -> dict[str, Column]:
    return {f"lex_{k}": flag(text(c).rlike(p)) for k, p in LEXICONS.items()}


def integrity_flags(c: Column) -> dict[str, Column]:
    """Signs of damaged or cut texts."""
    s = text(c)
    return {
        "mojibake": flag(s.rlike(MOJIBAKE)), "ends_in_punctuation": flag(F.right(F.regexp_replace(s, r"(?U)\s+\z", ""), F.lit(1)).isin(".", "!", "?", ";", ":")),
        "power_of_two": flag(F.length(s).isin(*(1 << k for k in range(8, 17)), *((1 << k) - 1 for k in range(8, 17)))),
    }


def question_share(c: Column) -> Column:
    return F.try_divide(F.length(text(c)) - F.length(F.replace(text(c), F.lit("?"), F.lit(""))), F.length(text(c)))


def prompt(title: Column, record: Column, template: str, limit: int = 7000) -> Column:
    """A prompt of a title and the first ``limit`` characters of a record; the template has two ``%s``."""
    return F.format_string(template, title, F.left(record, F.lit(limit)))
