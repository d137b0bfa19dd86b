"""A mini terminology in the release layout; ids and relations are invented."""

from __future__ import annotations

SOURCE = "TERMS"
CONCEPTS = [
    ("100", "IN", "metformin"), ("101", "IN", "lisinopril"), ("102", "IN", "atorvastatin"), ("103", "IN", "hydrochlorothiazide"), ("104", "IN", "aspirin"),
    ("110", "BN", "Lipitor"), ("120", "PIN", "atorvastatin calcium"), ("130", "MIN", "hydrochlorothiazide / lisinopril"),
    ("200", "SCDC", "metformin 500 MG"), ("201", "SCDC", "metformin 1000 MG"), ("202", "SCDC", "atorvastatin 20 MG"), ("203", "SCDC", "hydrochlorothiazide 12.5 MG"), ("204", "SCDC", "lisinopril 10 MG"),
    ("300", "SCD", "metformin 500 MG Oral Tablet"), ("301", "SCD", "metformin 1000 MG Oral Tablet"), ("302", "SCD", "atorvastatin 20 MG Oral Tablet"),
    ("303", "SCD", "hydrochlorothiazide 12.5 MG / lisinopril 10 MG Oral Tablet"), ("310", "SBD", "atorvastatin 20 MG Oral Tablet [Lipitor]"), ("400", "DF", "Oral Tablet"),
]
RELATIONS = [
    ("200", "has_ingredient", "100"), ("201", "has_ingredient", "100"), ("202", "has_ingredient", "102"), ("300", "consists_of", "200"), ("301", "consists_of", "201"),
    ("130", "has_part", "101"), ("303", "has_ingredients", "130"), ("203", "has_ingredient", "103"), ("204", "has_ingredient", "101"), ("310", "consists_of", "202"),
    ("302", "consists_of", "202"), ("310", "has_ingredient", "110"), ("310", "tradename_of", "302"), ("110", "tradename_of", "102"), ("120", "form_of", "102"),
    ("130", "has_part", "103"), ("303", "isa", "400"), ("303", "consists_of", "203"), ("303", "consists_of", "204"),
]


def name_line(concept: str, tty: str, name: str, lat: str = "ENG", pref: str = "Y", sab: str = SOURCE, suppress: str = "N", width: int = 18) -> str:
    cells = [""] * width
    for at, value in ((0, concept), (1, lat), (6, pref), (11, sab), (12, tty), (14, name), (16, suppress)):
        if at < width:
            cells[at] = value
    return "|".join(cells) + ("|" if width >= 18 else "")


def relation_line(src: str, rela: str, dst: str, sab: str = SOURCE, suppress: str = "") -> str:
    cells = [""] * 16
    for at, value in ((0, src), (3, "RO"), (4, dst), (7, rela), (10, sab), (14, suppress)):
        cells[at] = value
    return "|".join(cells) + "|"


def name_lines() -> list[str]:
    rows = [name_line(*c) for c in CONCEPTS]
    rows += [
        name_line("300", "PSN", "metformin 500 MG Oral Tablet"),
        name_line("104", "SY", "acetylsalicylic acid", pref="N"),
        name_line("901", "IN", "hidden", suppress="O"),
        name_line("902", "IN", "kept anyway", suppress="E"),
        name_line("903", "IN", "metformina", lat="SPA"),
        name_line("904", "IN", "elsewhere", sab="OTHER"),
        name_line("905", "IN", "narrow", width=17)[:-1],
        name_line("906", "IN", "***"),
    ]
    return rows


def relation_lines() -> list[str]:
    rows = [relation_line(*r) for r in RELATIONS]
    rows += [relation_line("100", "isa", "100"), relation_line("", "isa", "100"), relation_line("999", "isa", "100"), relation_line("300", "isa", "400", suppress="Y"), relation_line(*RELATIONS[0]), relation_line("100", "has_ingredient", "200")]
    return rows


def write_release(folder) -> tuple[str, str]:
    names, relations = folder / "names.txt", folder / "relations.txt"
    names.write_text("\n".join(name_lines()) + "\n", encoding="utf-8")
    relations.write_text("\n".join(relation_lines()) + "\n", encoding="utf-8")
    return str(names), str(relations)
