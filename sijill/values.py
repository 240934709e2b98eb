"""They must equal the archive's own for results to agree."""

from __future__ import annotations

# --- Fixed values: languages, in fallback order --------------------------------
LANGUAGES = ["tr", "en", "ar"]
DEFAULT_LANGUAGE = "tr"

# --- Fixed values: names of the twelve Hijri months ----------------------------
MONTHS = {
    "tr": ["Muharrem", "Safer", "Rebîülevvel", "Rebîülâhir", "Cemâziyelevvel", "Cemâziyelâhir",
           "Receb", "Şaban", "Ramazan", "Şevval", "Zilkade", "Zilhicce"],
    "en": ["Muharram", "Safar", "Rabi I", "Rabi II", "Jumada I", "Jumada II",
           "Rajab", "Sha'ban", "Ramadan", "Shawwal", "Dhu al-Qa'da", "Dhu al-Hijja"],
    "ar": ["المحرم", "صفر", "ربيع الأول", "ربيع الآخر", "جمادى الأولى", "جمادى الآخرة",
           "رجب", "شعبان", "رمضان", "شوال", "ذو القعدة", "ذو الحجة"],
}

# --- Fixed values: Arabic century names, 1st to 14th ----------------------------
CENTURY_WORD_AR = "القرن"
CENTURY_ORDINALS_AR = ["الأول", "الثاني", "الثالث", "الرابع", "الخامس", "السادس", "السابع",
                       "الثامن", "التاسع", "العاشر", "الحادي عشر", "الثاني عشر", "الثالث عشر", "الرابع عشر"]

# --- Fixed values: schools of law (key, tr, en, ar, colour) ---------------------
SCHOOLS = [
    ("hanefi", "Hanefî", "Ḥanafī", "الحنفي", "#2d5446"),
    ("maliki", "Mâlikî", "Mālikī", "المالكي", "#9a5b2e"),
    ("safii", "Şâfiî", "Shāfiʿī", "الشافعي", "#34507f"),
    ("hanbeli", "Hanbelî", "Ḥanbalī", "الحنبلي", "#7a3e62"),
    ("zahiri", "Zâhirî", "Ẓāhirī", "الظاهري", "#6b6b2f"),
    ("diger", "Diğer", "Other", "غير ذلك", "#6f6a60"),
]

# --- Fixed values: kinds of work (key, tr, en, ar) ------------------------------
WORK_TYPES = [
    ("kitap", "Kitap", "Book", "كتاب"),
    ("makale", "Makale", "Article", "بحث"),
    ("tez-doktora", "Doktora tezi", "PhD thesis", "أطروحة دكتوراه"),
    ("tez-yl", "Yüksek lisans tezi", "MA thesis", "رسالة ماجستير"),
    ("tahkik", "Tahkik", "Critical edition", "تحقيق"),
    ("ceviri", "Çeviri", "Translation", "ترجمة"),
    ("bildiri", "Bildiri", "Conference paper", "ورقة مؤتمر"),
    ("ansiklopedi", "Ansiklopedi maddesi", "Encyclopaedia entry", "مادة موسوعية"),
]

# --- Fixed values: harvest category → subject label -----------------------------
# The general category carries no label.
SUBJECT_OF_CATEGORY = [
    ("fikih_usulu", "Fıkıh usulü"),
    ("fikih_tarihi", "Fıkıh tarihi"),
    ("fukaha", "Şahıs çalışmaları"),
    ("mukayeseli", "Mukayeseli hukuk"),
    ("iktisat", "İslam iktisadı"),
]

# --- Fixed values: marks found in the records -----------------------------------
ORIGIN_HARVESTED = "otomatik"
STATUS_ACCEPTED = "kabul"
STATUS_REVIEW = "inceleme"
STATUS_REJECTED = "red"

# --- Fixed values: harvest settings ---------------------------------------------
OLDEST_YEAR = 1950
YEARS_BACK = 1
RESULTS_PER_QUERY = 3000
UNIT_RECHECK_DAYS = 30
RESTRICTED_RECHECK_DAYS = 90

# --- Fixed values: text lengths -------------------------------------------------
EXCERPT_LENGTH = 220
SNIPPET_LENGTH, SNIPPET_CUT = 260, 257
LABELLED_POINTS = 4
BOX_PADDING = 0.5

# --- Fixed values: columns of the scholars CSV ----------------------------------
SCHOLAR_CSV_COLUMNS = ["id", "nameAr", "nameTr", "nameEn", "madhhab", "birthHijri", "birthGregorian", "birthPlace",
                       "deathHijri", "deathGregorian", "deathPlace", "teacherIds", "studentIds", "sourcePage",
                       "sourceEntry", "url"]
