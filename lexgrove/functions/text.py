"""Column expressions over article numbers, item markers, widths, search terms and era dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kanji digits by value from 1.
KANJI_DIGITS = "一二三四五六七八九"
#: Kanji units, the greatest first.
KANJI_UNITS = {"千": 1000, "百": 100, "十": 10}
#: Years before the first of each era.
ERAS = {"明治": 1867, "大正": 1911, "昭和": 1925, "平成": 1988, "令和": 2018}


#: The white space, marks and numerals of the patterns below, up to strip_item_marker.


def trim_wide(x: Column) -> Column:
    """Without white space at the ends, the ideographic space and the byte order mark included."""
    return F.regexp_replace(x, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def article_num(x: Column) -> Column:
    """`第30条の2` as `30_2`; null where kanji numerals remain or x is null. Full-width digits pass through."""
    bare = F.replace(F.regexp_replace(trim_wide(x), "^第", ""), F.lit("条"), F.lit(""))
    return F.when(~bare.rlike("[一二三四五六七八九十百千]"), F.replace(bare, F.lit("の"), F.lit("_")))


def article_label(num: Column) -> Column:
    """`30_2` as `30の2`."""
    return F.translate(num, "_", "の")


def strip_item_marker(x: Column) -> Column:
    """Without leading kanji numerals or digits and the space after them; greedy, so a text that goes on with a numeral loses that too."""
    return F.regexp_replace(x, r"(?U)^[一二三四五六七八九十百0-9]+[\s﻿]*", "")


def heading(title: Column, article: Column, paragraph: Column, item: Column) -> Column:
    """Heading of an article, of a paragraph or of an item; an item needs its paragraph."""
    base = F.concat(F.lit("# "), title, F.lit(" 第"), article_label(article), F.lit("条"))
    p = F.concat(F.lit("第"), paragraph.cast("string"), F.lit("項"))
    i = F.concat(F.lit("第"), item.cast("string"), F.lit("号"))
    return F.concat(base, F.coalesce(p, F.lit("")), F.coalesce(F.when(paragraph.isNotNull(), i), F.lit("")))


#: Half-width katakana and marks in the order of their code points from U+FF61, and their full-width forms.
HALF_KANA = "｡｢｣､･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
FULL_KANA = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゛゜"
#: Full-width katakana that a voicing mark follows in half width, and what the two are in full width.
VOICED = {"ﾞ": ("カキクケコサシスセソタチツテトハヒフヘホウワヲ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴヷヺ"), "ﾟ": ("ハヒフヘホ", "パピプペポ")}


def fold_width(x: Column) -> Column:
    """Full-width ASCII and the ideographic space as their half-width forms."""
    wide = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
    return F.translate(x, wide, "".join(map(chr, range(0x21, 0x7F))) + " ")


def fold_kana(x: Column) -> Column:
    """Half-width katakana as full-width ones, a kana and the voicing mark after it as one code point; other marks stand alone.

    Kana are widened first but for the marks; then each mark's pairs are one pattern's matches, of which the kana is looked up. Texts without half-width kana pass as they are.
    """
    wide = F.translate(x, HALF_KANA[:-2], FULL_KANA[:-2])
    for mark, (plain, voiced) in VOICED.items():
        # a kana before its mark is marked by being followed by it: split there, and turn the last kana of each piece but the last
        pieces = F.split(wide, f"(?<=[{plain}]){mark}")
        turned = F.transform(pieces, lambda p, i: F.when(i < F.size(pieces) - 1, F.concat(F.substring(p, F.lit(1), F.length(p) - 1), F.translate(F.right(p, F.lit(1)), plain, voiced))).otherwise(p))
        wide = F.array_join(turned, "")
    wide = F.translate(wide, HALF_KANA[-2:], FULL_KANA[-2:])
    return F.when(x.rlike("[｡-ﾟ]"), wide).otherwise(x)


def has_all_terms(body: Column, words: Column) -> Column:
    """True if every space-separated term stands in the body, widths folded on both sides; false without terms."""
    terms = F.filter(F.split(trim_wide(fold_width(words)), r"(?U)\s+"), lambda t: t != "")
    return (F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(fold_width(body), t))


def kanji_number(x: Column) -> Column:
    """Kanji numerals as an int: by units up to 千 (`千二百三`) or by places (`一二〇三`); `元` is 1. Null for null, an empty text and other characters."""
    places = F.translate(x, "元〇" + KANJI_DIGITS, "10123456789")

    def step(acc: Column, c: Column) -> Column:
        unit = F.element_at(F.create_map(*[F.lit(v) for pair in KANJI_UNITS.items() for v in pair]), c)
        digit = acc["digit"] * 10 + F.coalesce(c.try_cast("int"), F.lit(0))
        # a unit without a digit before it counts once
        return F.struct(
            (acc["sum"] + F.coalesce(F.greatest(acc["digit"], F.lit(1)) * unit, F.lit(0))).alias("sum"),
            F.when(unit.isNotNull(), 0).otherwise(digit).alias("digit"),
        )

    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("digit"))
    read = F.aggregate(F.split(places, ""), start, step, lambda acc: acc["sum"] + acc["digit"])
    return F.when(x.rlike(f"^[元〇{KANJI_DIGITS}{''.join(KANJI_UNITS)}]{{1,9}}$"), read)


def kanji_numeral(n: Column) -> Column:
    """1 to 9999 by units (`千二百三`); null beyond."""
    left, parts = n.cast("int"), []
    for unit, size in KANJI_UNITS.items():
        many = F.floor(left / size).cast("int")
        parts.append(F.when(many == 0, "").when(many == 1, unit).otherwise(F.concat(F.substring(F.lit(KANJI_DIGITS), many, F.lit(1)), F.lit(unit))))
        left = left % size
    ones = F.when(left == 0, "").otherwise(F.substring(F.lit(KANJI_DIGITS), left, F.lit(1)))
    return F.when(n.between(1, 9999), F.concat(*parts, ones))


def article_num_kanji(x: Column) -> Column:
    """As article_num, and with kanji numerals read: `第千二百三条の二` as `1203_2`; null where a part is neither digits nor kanji numerals."""
    bare = F.replace(F.regexp_replace(trim_wide(x), "^第", ""), F.lit("条"), F.lit(""))
    parts = F.transform(F.split(bare, "の"), lambda p: F.when(p.rlike("^[0-9０-９]+$"), fold_width(p)).otherwise(kanji_number(p).cast("string")))
    return F.when(F.forall(parts, lambda p: p.isNotNull()), F.array_join(parts, "_"))


def era_date(x: Column) -> Column:
    """`昭和二十二年四月七日` as a date; null where it is none."""
    below_100 = f"([{KANJI_DIGITS}]?十[{KANJI_DIGITS}]?|[{KANJI_DIGITS}])"
    pattern = f"^({'|'.join(ERAS)})(元|{below_100})年{below_100}月{below_100}日$"
    piece = lambda i: F.regexp_extract(x, pattern, i)
    before = F.lit(None).cast("int")
    for era, years in ERAS.items():
        before = F.when(piece(1) == era, F.lit(years)).otherwise(before)
    day = [kanji_number(piece(i)) for i in (2, 4, 5)]
    return F.when(x.rlike(pattern), F.try_to_date(F.format_string("%04d-%02d-%02d", before + day[0], day[1], day[2])))


def law_url(law_id: Column, base: str) -> Column:
    return F.concat(F.lit(base), law_id)


def iso_instant(ts: Column) -> Column:
    """UTC milliseconds; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def positive_int(x: Column, default: int) -> Column:
    """A setting as an integer; blank, malformed and 0 give the default."""
    return F.coalesce(F.nullif(x.try_cast("int"), F.lit(0)), F.lit(default))


def listed(x: Column) -> Column:
    """Comma-separated names, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(x, ","), trim_wide), lambda s: s != "")
