"""Challenge pages, tasks' modes, consent buttons: decisions by fixed lexicons, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import text_of

#: What challenge widgets load, and what interstitials say.
WIDGETS = (
    r"challenges\.cloudflare\.com|cdn-cgi/challenge-platform|__cf_chl|cf_chl_|js\.hcaptcha\.com|hcaptcha\.com/1/api\.js"
    r"|google\.com/recaptcha/api|gstatic\.com/recaptcha|recaptcha/api\.js|captcha-delivery\.com|datadome|px-cdn\.net"
    r"|px-cloud\.net|_pxhd|awswaf\.com|amazonaws\.com/captcha"
)
PHRASES = (
    "checking your browser|verify(?:ing)? (?:that )?you are (?:a )?human|just a moment|attention required"
    "|enable javascript and cookies to continue|unusual traffic|are you a robot|ddos protection by"
    "|please stand by, while we are checking"
)
#: How a page sends readers on, and what tasks about documentation say.
META_REFRESH = r"""<meta[^>]+http-equiv\s*=\s*["']?refresh"""
DOCS_TASK = r"\bdocs?\b|documenta|dokumenta|api[\s_-]*reference|\bsdk\b"
#: What consent banners are about, and what their buttons say.
CONSENT_TOPIC = "cookie|consent|gdpr|privacy|rgpd|dsgvo"
REJECT = (
    "reject|decline|refuse|deny|necessary only|only necessary|rifiut|solo necessari|ablehn|nur notwendige|refuser"
    "|tout refuser|rechaz|solo necesarias|recus|rejeit|weiger|alleen noodzakelijk|avvisa|avslå|afvis|kun nødvendige"
    "|hylkää|odrzuć|odmítn|elutasít|resping|отклон|отказ|拒绝|全部拒绝|拒否|거부"
)
ACCEPT = (
    "accept|agree|allow|got it|i understand|understood|accett|consent[io]|ho capito|akzeptier|zustimm|einverstanden"
    "|verstanden|accepter|j'accepte|tout accepter|acept|aceit|de acuerdo|accepteer|akkoord|acceptera|godkänn|godta"
    "|accepter alle|hyväksy|akceptuj|zgadzam|přijm|souhlas|elfogad|accept toate|принять|принима|соглас|同意|接受"
    "|同意する|승인|동의"
)
DISMISS = (
    "^ok$|^okay$|close|dismiss|continue|no,? thanks|not now|maybe later|chiudi|schließen|weiter|fermer|continuer|cerrar"
    "|continuar|fechar|sluiten|luk|stäng|lukk|sulje|zamknij|zavří|bezár|închide|закрыть|продолжить|关闭|閉じる|닫기|^[×✕x]$"
)
THIN = 800
BLOCKING = (403, 429, 503)
BACKOFF_MS, MOST_BACKOFF_MS = 2500, 15000


def _says(c: Column, pattern: str) -> Column:
    return text_of(c).rlike(f"(?iu){pattern}")


def challenge_signal(status: Column, mitigated: Column, html: Column, content_len: Column) -> Column:
    """Which sign of a bot defence a response gives: header, widget, interstitial, or null for content."""
    blocked = F.coalesce(status, F.lit(0)).isin(*BLOCKING)
    return (
        F.when(_says(mitigated, "challenge"), "header")
        .when(~F.coalesce(content_len < THIN, F.lit(False)), None)  # the length is taken once
        .when(_says(html, WIDGETS), "widget")
        .when((blocked | _says(html, META_REFRESH)) & _says(html, PHRASES), "interstitial")
    )


def challenge_backoff_ms(retry_after: Column, now: Column | None = None) -> Column:
    """Milliseconds to wait: as the header asks, in seconds or by date, up to a bound; else a default."""
    now = F.current_timestamp() if now is None else now
    seconds = F.when(F.trim(retry_after).rlike(r"^\d+(\.\d+)?$"), F.trim(retry_after).cast("double"))
    at = F.try_to_timestamp(F.regexp_replace(retry_after, r"^\s*[A-Za-z]{3},\s*|\s*GMT\s*$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = (at.cast("double") - now.cast("double")) * 1000
    most = F.lit(float(MOST_BACKOFF_MS))
    return (
        F.when(seconds > 0, F.least(most, seconds * 1000))
        .when(at.isNotNull(), F.least(most, F.greatest(F.lit(0.0), until)))
        .otherwise(float(BACKOFF_MS))
        .cast("long")
    )


def is_docs_task(task: Column) -> Column:
    return text_of(task).rlike(f"(?i){DOCS_TASK}")


def mode_behavior(mode: Column, task: Column) -> Column:
    """(mode, docs_shortcuts, scope_sections, link_gate)."""
    m = F.when(mode.isin("complete", "targeted"), mode).otherwise("auto")
    docs = is_docs_task(task)
    return F.struct(
        m.alias("mode"),
        F.when(m == "complete", True).when(m == "targeted", False).otherwise(docs).alias("docs_shortcuts"),
        F.when(m == "complete", False).when(m == "targeted", True).otherwise(~docs).alias("scope_sections"),
        (m != "complete").alias("link_gate"),
    )


def pick_consent(buttons: DataFrame) -> DataFrame:
    """(overlay_text, id, label): the button that closes each overlay. buttons: id, label, area, overlay_text, href.

    A consent banner is left by refusing, else accepting, else dismissing, else by its largest short button; any
    other overlay only by dismissing. Links never count.
    """
    b = buttons.filter((text_of(F.col("label")) != "") & (text_of(F.col("href")) == ""))
    b = b.withColumn("overlay_text", text_of(F.col("overlay_text")))
    consent, label = _says(F.col("overlay_text"), CONSENT_TOPIC), F.col("label")
    rank = (
        F.when(consent & _says(label, REJECT), 0)
        .when(consent & _says(label, ACCEPT), 1)
        .when(_says(label, DISMISS), 2)
        .when(consent & (F.length(label) < 40), 3)
    )
    area = F.when(F.col("rank") == 3, -F.coalesce(F.col("area"), F.lit(0))).otherwise(0)
    b = b.withColumn("rank", rank).filter("rank is not null")
    first = F.row_number().over(W.partitionBy("overlay_text").orderBy("rank", area, "id"))
    return b.withColumn("nth", first).filter("nth = 1").select("overlay_text", "id", "label")
