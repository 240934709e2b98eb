"""Small records of our own, one edge case each."""

from pathlib import Path

SCHOLARS = {
    "ali": '''---
name: { ar: "علي", tr: "Ali b. Veli", en: "Ali b. Wali, tr: \\"x\\"" }
fullNameAr: "علي بن ولي"
madhhab: hanefi
birth:
  hijri: 500
  place: sam
death:
  hijri: 534
  month: 3
  alt: [535, 540]
  place: kayip
places:
  - { place: sam, role: nisbe }
  - { place: bagdat, role: ders }
teachers: ["Hoca Bir", "Hoca İki"]
works:
  - { ar: "كتاب" }
summary: { tr: "Bir âlim: uzun.", en: "A scholar: long." }
addedAt: 2026-01-02
order: 2
featured: true
sources:
  - book: "Kitap"
    bookTr: "el-Kitap"
    author: "Yazar (v. 1)"
    authorTr: "Y"
    edition: "Kuzey: Örnek Yayın, 1350"
    page: "12-13"
    entry: "46a"
---
**علي بن ولي**

نص أول **ثان** نص.
''',
    "bos": '''---
name: { ar: "ب", tr: "Boş", en: "Empty" }
fullNameAr: "ب"
madhhab: hanefi
death: {}
summary: { tr: "", en: "E" }
addedAt: 2026-01-02
order: 1
featured: false
sources:
  - book: "Kitap"
    page: "9"
    entry: "9"
---
Gövde.
''',
    "omer": '''---
name: { ar: "عمر", tr: "Ömer", en: "Umar" }
fullNameAr: "عمر"
madhhab: safii
birth:
  hijri: 493
  month: 12
  day: 10
death: {}
places:
  - { place: sam, role: ikamet }
students: ["Ali"]
summary: { tr: "t", en: "e" }
addedAt: 2026-01-03
order: 3
featured: false
sources:
  - book: "Kitap"
    page: "10"
    entry: "10"
---
**Ömer** metin
''',
    "yakub": '''---
name: { ar: "ي", tr: "Yakub", en: "Jacob" }
fullNameAr: "ي"
madhhab: hanefi
death:
  hijri: 735
  month: 7
  day: 30
  approx: true
summary: { tr: "t", en: "e" }
addedAt: 2026-01-03
order: 4
featured: false
sources:
  - book: "Kitap"
    page: "11"
    entry: "11"
---
Metin
''',
}

WORKS = {
    "kaya-hukuk-2020": '''type: "tez-yl"
title: "Hukuk \\"Usulü\\" Üzerine"
titleTranslation: {"en": "On Legal Theory"}
authors: ["Kaya, Ali"]
language: "tr"
year: 2020
university: "Örnek Üniversitesi, Enstitü"
city: "İstanbul"
department: "Temel / İslam Hukuku / Dal"
advisors: ["A Bir", "B İki"]
topics: ["Fıkıh usulü", "Şahıs çalışmaları"]
url: "https://example.org/1"
fullText: "https://example.org/1.pdf"
abstract: "Özet; \\n ikinci satır."
yokId: 101
origin: otomatik
addedAt: 2026-01-05
''',
    "az-nodate": '''type: tez-doktora
title: "Az Kayıt"
authors: ["Az"]
language: tr
university: "Tek"
city: "Konya"
addedAt: 2026-01-05
''',
    "demir-arapca-2021": '''type: tez-doktora
title: "فقه\x07 الحديث"
authors: ["Demir, Can"]
language: ar
year: 2021
university: "Örnek Üniversitesi, Enstitü"
pageCount: 311
abstract: "Kısa"
titleTranslation: {"tr": "Hadis İlmi"}
yokId: 102
addedAt: 2026-01-06
''',
}

POSTS = {
    "tr/ilk": "---\nphoto: p\ntitle: 'Başlık: bir'\ndate: 2026-09-21\nsummary: Özet, iki: üç.\ntags: [duyuru, haber]\n---\n\nGövde --- metin\n",
    "en/ilk": '---\nphoto: p\ntitle: "Title \\"one\\""\ndate: 2026-09-22\nsummary: S\ntags: ["news"]\n---\nBody\n',
    "ar/tek": "---\nphoto: q\ntitle: عنوان\ndate: 2026-09-23\nsummary: م\ntags:\n  - a\n  - b\n---\nنص\n",
}

PAGES = {
    "tr/lisans": "---\ntitle: Lisans\nlead: L\nphoto: p\n---\n\nMetin\n",
    "en/lisans": "---\ntitle: Licence\nlead: L\nphoto: p\n---\n\nText\n",
}

LINKS = '{"ali": {"teachers": {"0": "omer", "1": "kayip-hoca"}}, "omer": {"students": {"0": "ali"}, "teachers": {"0": "kayip-hoca"}}}'
PLACES = '{"sam": {"name": {"tr": "Şam"}, "lat": 33.5, "lng": 36.3}, "bagdat": {"name": {"tr": "Bağdat"}, "lat": 33.3, "lng": 44.4}}'


def write_content(folder: str) -> dict[str, str]:
    """The fixture as the folders the readers expect."""
    root = Path(folder)
    for name, files, extension in [("scholars", SCHOLARS, "md"), ("works", WORKS, "yaml"), ("posts", POSTS, "md"), ("pages", PAGES, "md")]:
        for stem, text in files.items():
            path = root / "content" / name / f"{stem}.{extension}"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text, encoding="utf-8")
    for name, text in [("links", LINKS), ("places", PLACES)]:
        (root / name).mkdir()
        (root / name / f"{name}.json").write_text(text, encoding="utf-8")
    return {k: str(root / k) for k in ("content", "links", "places")}


def exported(folder: str) -> bytes:
    """An export: its part files in name order."""
    return b"".join(p.read_bytes() for p in sorted(Path(folder).glob("part-*")))
