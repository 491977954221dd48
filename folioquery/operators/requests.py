"""What comes in from outside, and plans for it: shared texts, settings screens, alarms, timers, calls, web searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.functions.text import shared_text

# ---- fixed values: actions of requests, settings screens (label, action, names), words around their names ----
PROCESS_TEXT, SEND, OPEN_SEARCH = "android.intent.action.PROCESS_TEXT", "android.intent.action.SEND", "app.action.OPEN_SEARCH"
SETTINGS = [
    ("Wi-Fi", "android.settings.WIFI_SETTINGS", ["wifi", "wi-fi", "wi fi", "wlan", "వైఫై", "వై-ఫై", "वाईफाई", "वाई-फाई", "वाईफ़ाई"]),
    ("Bluetooth", "android.settings.BLUETOOTH_SETTINGS", ["bluetooth", "bt", "బ్లూటూత్", "ब्लूटूथ"]),
    ("Battery saver", "android.settings.BATTERY_SAVER_SETTINGS", ["battery", "battery saver", "బ్యాటరీ", "बैटरी"]),
    ("Display", "android.settings.DISPLAY_SETTINGS", ["display", "brightness", "screen", "డిస్ప్లే", "బ్రైట్‌నెస్", "डिस्प्ले", "ब्राइटनेस"]),
    ("Sound", "android.settings.SOUND_SETTINGS", ["sound", "volume", "ringtone", "సౌండ్", "వాల్యూమ్", "साउंड", "वॉल्यूम"]),
    ("Location", "android.settings.LOCATION_SOURCE_SETTINGS", ["location", "gps", "లొకేషన్", "लोकेशन"]),
    ("Airplane mode", "android.settings.AIRPLANE_MODE_SETTINGS", ["airplane", "airplane mode", "flight mode", "ఎయిర్‌ప్లేన్", "एयरप्लेन", "फ्लाइट मोड"]),
    ("Mobile data usage", "android.settings.DATA_USAGE_SETTINGS", ["data usage", "mobile data", "data", "డేటా", "डेटा"]),
    ("NFC", "android.settings.NFC_SETTINGS", ["nfc"]),
    ("Storage", "android.settings.INTERNAL_STORAGE_SETTINGS", ["storage", "స్టోరేజ్", "स्टोरेज"]),
    ("Apps", "android.settings.APPLICATION_SETTINGS", ["manage apps", "all apps", "app settings"]),
    ("Default apps", "android.settings.MANAGE_DEFAULT_APPS_SETTINGS", ["default apps"]),
    ("Language", "android.settings.LOCALE_SETTINGS", ["language", "languages", "భాష", "भाषा"]),
    ("Date and time", "android.settings.DATE_SETTINGS", ["date and time", "date time", "time zone", "timezone"]),
    ("Accessibility", "android.settings.ACCESSIBILITY_SETTINGS", ["accessibility"]),
    ("Security", "android.settings.SECURITY_SETTINGS", ["security", "సెక్యూరిటీ", "सिक्योरिटी"]),
    ("VPN", "android.settings.VPN_SETTINGS", ["vpn"]),
    ("Developer options", "android.settings.APPLICATION_DEVELOPMENT_SETTINGS", ["developer options", "developer"]),
]
SETTINGS_NOISE = {"open", "go", "to", "settings", "setting", "setup", "turn", "on", "off", "my", "the", "సెట్టింగ్స్", "సెట్టింగ్", "ఓపెన్", "सेटिंग", "सेटिंग्स", "खोलो", "खोलें", "ओपन"}


def parse(requests: DataFrame) -> DataFrame:
    """requests(request_id, action, type, process_text, send_text, stream_uri) -> request_id, kind (SEARCH, TEXT, IMAGE; null: none), value."""
    image = F.col("type").startswith("image/")
    texts = F.col("type").isNull() | F.col("type").startswith("text/")
    value = (
        F.when(F.col("action") == PROCESS_TEXT, shared_text(F.col("process_text")))
        .when((F.col("action") == SEND) & F.coalesce(image, F.lit(False)), F.when(F.trim("stream_uri") != "", F.col("stream_uri")))
        .when((F.col("action") == SEND) & texts, shared_text(F.col("send_text")))
    )
    kind = F.when(F.col("action") == OPEN_SEARCH, "SEARCH").when(value.isNotNull(), F.when((F.col("action") == SEND) & F.coalesce(image, F.lit(False)), "IMAGE").otherwise("TEXT"))
    return requests.select("request_id", kind.alias("kind"), value.alias("value"))


def clock(minutes: Column) -> Column:
    """Minutes of the day as 6:05 PM (18:05)."""
    hour, minute = F.floor(minutes / 60).cast("int"), F.lpad((minutes % 60).cast("string"), 2, "0")
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(twelve.cast("string"), F.lit(":"), minute, F.when(hour < 12, " AM").otherwise(" PM"), F.lit(" ("), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), minute, F.lit(")"))


def length(seconds: Column) -> Column:
    """Seconds as 1 h 30 min 5 s, without what is zero."""
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    return F.concat_ws(" ", part(F.floor(seconds / 3600), " h"), part(F.floor(seconds % 3600 / 60), " min"), part(seconds % 60, " s"))


def command_plans(commands: DataFrame) -> DataFrame:
    """commands(query_id, kind, value) of alarms (minutes of the day) and timers (seconds) -> query_id, action, question, target."""
    alarm = F.col("kind") == "ALARM"
    shown = F.when(alarm, clock(F.col("value"))).otherwise(length(F.col("value")))
    question = F.concat(F.when(alarm, "Set an alarm for ").otherwise("Start a timer for "), shown, F.lit("?"))
    target = F.when(alarm, F.concat(F.floor(F.col("value") / 60).cast("string"), F.lit(":"), (F.col("value") % 60).cast("string"))).otherwise(F.col("value").cast("string"))
    return commands.select("query_id", F.col("kind").alias("action"), question.alias("question"), target.alias("target"))


def contact_plans(contacts: DataFrame) -> DataFrame:
    """contacts(id, name, number): a call of a saved contact; the number keeps its digits and plus signs."""
    return contacts.select("id", F.lit("CALL").alias("action"), F.concat(F.lit("Call "), "name", F.lit("?")).alias("question"), F.regexp_replace("number", r"[^0-9+]", "").alias("target"))


def web_plans(texts: DataFrame) -> DataFrame:
    """texts(query_id, text): a search of the web for the text as it was typed; a blank one has none."""
    return texts.where(F.trim("text") != "").select("query_id", F.lit("WEB").alias("action"), F.lit("Search the web?").alias("question"), F.col("text").alias("target"))


def subjects(facts: DataFrame) -> DataFrame:
    """facts(fact_id, kind, value, label, raw, confidence, item_title, source) with title (at most 100 letters), shared text's head and low_confidence."""
    label = F.when(F.rtrim(F.regexp_replace(F.trim("label"), r"[:\- ]+$", "")) != "", F.regexp_replace(F.trim("label"), r"[:\- ]+$", ""))
    item = F.when(F.trim(F.coalesce("item_title", F.lit(""))) != "", F.trim("item_title"))
    title = F.coalesce(F.concat(item, F.lit(": "), label), label, item, F.concat(F.lit("Date from "), "source"))
    what = F.coalesce(label, F.initcap(F.lower("kind")))
    head = F.concat(F.coalesce(F.concat(item, F.lit(" - ")), F.lit("")), what, F.lit(": "), F.col("value"))
    return facts.withColumns({"title": F.substring(title, 1, 100), "head": head, "low_confidence": (F.col("confidence") < 0.6) | F.col("value").startswith("--")})
