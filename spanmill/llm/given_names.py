"""Given names and their short forms, as fixed values that callers may replace."""

from __future__ import annotations

# A given name, then short forms of it.
SHORT_FORMS = """
Abigail Abby Gail
Alexander Alex Sandy Xander Lex
Anthony Tony Ant
Benjamin Ben Benny Benji
Christina Tina Chris Chrissy Christy
Christopher Chris Kit Topher
Deborah Debbie Deb Debra
Dmitri Dima Mitya
Edward Ed Ned Ted Eddie
Eleanor Ellie Nell Nora Lena
Elizabeth Liz Beth Betty Lizzie Eliza
Frances Fran Fanny Francie
Frederick Fred Freddie Rick
Gabriella Gabi Gabby Ella
Gregory Greg
Helena Lena Nell Helen
Henry Harry Hank Hal
Isabella Bella Isa Izzy
Ivan Vanya
Jennifer Jenny Jen
Jonathan Jon Jonny Nathan
Joseph Joe Joey Jo
Karim
Katherine Kate Kathy Katie Kat Kit
Lawrence Larry Laurie
Lucille Lucy Lu
Margaret Maggie Peggy Meg Marge
Mei
Michael Mike Mick Mickey
Nadia Nadya
Nicholas Nick Nicky Nico
Olga Olya
Oskar Ossi
Patricia Pat Patty Trish Tricia
Patrick Paddy Pat
Quentin Quent
Rebecca Becky Becca
Richard Dick Rick Rich Richie
Robert Bob Rob Bobby Bert Robbie
Samuel Sam Sammy
Susan Sue Susie Suzy
Theodore Ted Theo Teddy
Theresa Terry Tess Tessa Tracy
Thomas Tom Tommy
Ulrich Uli
Ursula Uschi Ulla
Victoria Vicky Tori
Vincent Vince Vinnie
Wilhelmina Mina Willa Minnie
William Bill Will Billy Willy Liam
Yusuf
Yvonne Evie Vonnie
Zachary Zack Zach Zak
Zeynep Zey
"""


def short_forms(text: str = SHORT_FORMS) -> dict[str, tuple[str, ...]]:
    """Lower-cased name -> the full given names that it may stand for (itself where it is full)."""
    found: dict[str, list[str]] = {}
    for line in text.split("\n"):
        names = line.lower().split()
        for n in names:
            found.setdefault(n, []).append(names[0])
    return {n: tuple(dict.fromkeys(full)) for n, full in found.items()}
