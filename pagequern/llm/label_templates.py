"""Makes templates.tsv, the bounded table of labelled templates that problem 4's classifier is fitted on.

    python -m pagequern.llm.label_templates BASE

reads BASE/scrapes.parquet, groups its lines as the operator does, and labels the groups with the expressions
below, which were written while reading them; lines that occur on several sites are all taken, of the others
NEGATIVES by hash, short ones (titles) first. Messages and ordinary lines of other languages and wordings, written by hand, are added with
the behaviour of a line seen once. This is a tool for making labels: the operator doesn't use it.
"""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NEGATIVES = 4000

# Messages that stand instead of content, matched against a whole masked line in lower case.
_MESSAGES = [
    # scripts required
    r".{0,60}\b(?:enable|activate|turn on|switch on|allow)\b.{0,24}\b(?:javascript|scripts?)\b.{0,60}",
    r".{0,60}\b(?:javascript|scripts?)\b.{0,24}\b(?:is|are|has been|turned|must be)?\s?(?:required|disabled|needed|turned on|turned off|enabled)\b.{0,60}",
    r".{0,60}\b(?:requires?|needs?|without)\b (?:javascript|scripts?)\b.{0,50}",
    r".{0,40}\b(?:aktivieren|aktivierte)\b.{0,20}(?:javascript|skripte?).{0,60}|.{0,30}javascript.{0,20}aktivieren.{0,40}",
    r".{0,40}\b(?:activer|activez|ative|active|activar|habilite|habilitar)\b.{0,14}javascript.{0,50}",
    r".{0,30}javascript.{0,40}(?:włącz|nie zadziała).{0,40}|.{0,40}(?:włącz|obsług).{0,20}(?:javascript|skrypt).{0,30}",
    r".{0,30}включите.{0,20}javascript.{0,30}|.{0,40}javascript.{0,12}有効.{0,20}",
    r"noscript:.{0,80}|loading(?:…|\.\.\.)?",
    r".{0,30}\bbrowser is not supported\b.{0,80}",
    # errors
    r"(?:http |error |erreur |fehler )?[45]\d\d\b.{0,60}|(?:http|error|erreur|fehler|kod|código)[ :]{1,3}(?:[45]\d\d|<n>).{0,80}",
    r".{0,30}\b(?:not found|nicht gefunden|no encontrada|non trouvée|introuvable|não encontrada|nie istnieje|не найдена)\b.{0,30}|.{0,14}見つかりません.{0,10}",
    r"(?:oops|whoops|sorry)\b.{0,60}(?:can't|cannot|could not|couldn't|not available|unavailable).{0,50}",
    r"(?:nothing here\.|the link may be broken).{0,70}|the address .{1,60} leads nowhere.{0,30}",
    r".{0,20}\binternal server error\b.{0,20}|something (?:broke|went wrong)\b.{0,70}",
    r".{0,12}\b(?:bad gateway|service unavailable|gateway time-?out)\b.{0,40}|no backend can take this request.{0,40}",
    r"(?:error while|fatal error|uncaught|unhandled|warning: undefined|parse error|stack trace|exception in thread)\b.{0,90}|traceback \(most recent call last\).{0,10}|panic: .{0,70}|goroutine <n> .{0,20}|\w*error: .{0,60}",
    r"[{].{0,10}error\W.{0,140}[}]|<\?xml.{0,40}<error>.{0,140}",
    r".{0,40}(?:cannot|can't|can not) provide a secure connection.{0,30}|.{0,30}\bthis (?:entry|page|item) was (?:withdrawn|removed|deleted)\b.{0,20}",
    r"(?:este|esta|esse|essa)\b.{0,30}(?:não está mais disponível|ya no está disponible).{0,10}|.{0,40}\bnot available in your (?:region|country)\b.{0,10}|diese[rs]? .{0,30}nicht mehr verfügbar.{0,10}",
    # blocks, logins, maintenance
    r"access denied\W?|zugriff verweigert\b.{0,50}|accès refusé\b.{0,60}|acceso denegado\b.{0,50}|acesso negado\b.{0,50}|you may not open .{0,60}",
    r"(?:verify|confirm) (?:that )?you are (?:a )?human\b.{0,60}|(?:solve|complete) the captcha\b.{0,60}|.{0,60}checks your connection\b.{0,40}|unusual traffic\b.{0,90}|are you a robot.{0,40}",
    r"(?:too many requests|rate limit (?:reached|exceeded))\b.{0,80}",
    r"(?:your |the )?session (?:has )?(?:expired|timed out)\b.{0,60}|(?:please )?(?:log|sign) in (?:again|to (?:see|view|read|continue))\b.{0,40}|(?:ihre|votre|su|sua|tu) (?:sitzung|session|sesión|sessão)\b.{0,20}(?:abgelaufen|expiré|expirado|expirou).{0,60}",
    r".{0,60}\b(?:is )?down for (?:scheduled )?maintenance\b.{0,40}|wartungsarbeiten\b.{0,60}|we'll be right back\W?|under maintenance\W?|en mantenimiento\b.{0,30}|em manutenção\b.{0,30}|site en maintenance\b.{0,30}",
    # filler
    r"lorem ipsum\b.{0,400}|tbd|todo|coming soon\W?|under construction\W?|(?:asdf ?){2,}.{0,30}|(?:test ?){3,}.{0,20}|(?:(?:text|blah|foo|bar|word)\b[ .]*){4,}|[x ]{8,}",
    r"dummy (?:copy|text)\b.{0,40}|sample text\b.{0,50}|click edit button\b.{0,50}|add a short description\b.{0,50}|your (?:headline|text|title|content) (?:goes )?here\W?|image caption goes here\W?|placeholder text\b.{0,30}",
    r"hier steht ihr blindtext\b.{0,60}|texto de (?:ejemplo|exemplo|relleno)\b.{0,50}|texte (?:d'exemple|factice)\b.{0,50}|hello! this first entry was made for you\b.{0,40}|hello world\W?",
]
# Words of made-up Latin.
_LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed congue nectar sapien blandi aliquo egestas hodie nullam dictum magnis tortum vulpem tempus portam justo vitor risum mollit cursus ornatu sintum massa quasi etiam vulputate pellentesque tincidunt aliquam viverra"

# Messages that the expressions don't know, found by reading what a first fit took for messages.
READ = ["die angeforderte seite <path> existiert nicht (mehr)."]
# Written by hand: messages (1) and ordinary lines (0).
BY_HAND = {
    1: [
        "your request has been blocked by our firewall", "this site can't be reached", "la page demandée est inaccessible", "seite konnte nicht geladen werden", "ha ocurrido un error inesperado", "si è verificato un errore imprevisto", "pagina non trovata",
        "devi attivare javascript per continuare", "deze pagina bestaat niet", "schakel javascript in om verder te gaan", "页面不存在", "请启用javascript后继续", "访问被拒绝", "sidan kunde inte hittas", "aktivera javascript för att fortsätta",
        "your ip address has been temporarily blocked", "you have been logged out. sign in to continue", "this account has been suspended", "the requested url was not found on this server", "an unexpected error occurred. please try again", "service temporarily unavailable",
        "your connection was interrupted", "this page could not be loaded", "javascript appears to be disabled in your browser", "we need to make sure you are not a robot", "your session timed out", "connection refused", "forbidden", "bad request", "page not found", "nothing was found here",
        "this website is under construction", "check back soon", "insert your text here", "lorem ipsum dolor sit amet consectetur adipiscing elit", "this is a sample page", "example text goes here", "accesso negato", "toegang geweigerd", "sitzung abgelaufen. bitte erneut anmelden",
        "votre session a expiré", "su sesión ha caducado", "ошибка сервера", "доступ запрещен", "アクセスが拒否されました", "メンテナンス中です", "site en maintenance", "sitio en mantenimiento", "strona w budowie", "dostęp zabroniony", "błąd serwera", "acesso negado", "erro interno do servidor",
        "this page is not available in your country", "the page you are looking for was moved or deleted", "uncaught exception in thread main", "segmentation fault", "null pointer exception at <path>:<n>", "database error: connection lost", "error: cannot read properties of undefined",
    ],
    0: [
        "this page is a short guide for readers.", "this page is the long guide for writers.", "the function returns null when the queue is empty.", "our team blocks bad requests before they reach the server.", "we moved the page about sessions to the new guide.", "il motore legge le pagine ogni notte.",
        "de server leest elke nacht de pagina's.", "服务器每晚读取页面。", "how to handle an error page", "a guide to rate limits", "working with access tokens", "errors are written to the log and the run goes on.", "the script runs in the browser and needs no server.", "scripts are loaded after the page.", "le moteur lit les pages chaque nuit.",
        "home", "menu", "search", "contact", "about us", "subscribe", "release notes", "changelog", "getting started", "frequently asked questions", "kontakt", "suche", "inicio", "accueil", "reading a status page", "a page that says “access denied” is not always blocked.", "we log “page not found” and go on with the next link.", "the words “please enable javascript” on a page mean that it needs a browser.", "the phrase \"lorem ipsum\" fills layouts until there is text.", "sites that say “session expired” want a new login, so the crawler signs in again.", "follow scripts with care", "read errors in the log", "sessions expire after an hour unless they are renewed.", "the maintenance window is on sunday.",
    ],
}


def _is_message(text: Column) -> Column:
    plain = ~text.rlike("[“”\"`«»「」]") | text.rlike(r"^[{<]")
    words = F.filter(F.split(F.regexp_replace(text, "[^a-z ]", ""), " +"), lambda w: w != "")
    latin = F.size(F.filter(words, lambda w: w.isin(_LATIN.split())))
    filler = F.when(text.rlike(r"\b(?:" + "|".join(_LATIN.split()) + r")\b"), (F.size(words) >= 4) & (latin * 2 >= F.size(words))).otherwise(F.lit(False))
    return F.when(F.length(text) <= 460, plain & text.rlike("^(?:" + "|".join(_MESSAGES) + ")$")).otherwise(F.lit(False)) | filler


def main(base: str) -> None:
    from pagequern.llm import residue
    from pagequern.session import local_session, ship_package, table

    spark = local_session()
    ship_package(spark)
    groups, _, _ = residue.line_groups(residue.record_lines(residue.scrape_records(table(spark, base, "scrapes"))))
    rows = groups.withColumn("label", F.when(_is_message(F.regexp_replace("template", "<\\*>", "x")) | F.col("template").isin(READ), 1).otherwise(0))
    ok = (F.col("label") == 1) | ((F.col("low") < F.col("high")) & (F.col("lines") > 2)) | (F.pmod(F.xxhash64("template"), F.lit(100)) < F.when(F.col("template").rlike("[“”\"«»「」`]"), 40).when(F.size(F.split("template", " ")) < 9, 60).otherwise(15))
    got = rows.where(ok).select("label", *residue.BEHAVIOUR, "template").where(~F.col("template").rlike(f"^{residue._FRAME}$")).toPandas()
    some = got[(got.label == 0) & (got.low == got.high)].sort_values("template", key=lambda t: t.map(lambda x: (len(x.split()) > 8, zlib.crc32(x.encode())))).head(NEGATIVES)
    got = pd.concat([got[(got.label == 1) | (got.low < got.high)], some])
    once = {"lines": 1, "low": 0, "high": 0, "share": 1.0, "bad": 0, "known": 0}
    hand = pd.DataFrame([{"label": k, "template": t, **once} for k, v in BY_HAND.items() for t in v])
    got["high"] = (got.low < got.high).astype(int)
    got["low"] = 0
    # a message stays one where a small corpus has it only once
    single = got[(got.label == 1) & (got.lines > 1)].assign(share=lambda x: x.share / x.lines, lines=1, high=0, bad=0, known=0)
    out = pd.concat([got.assign(copy=0), single.assign(copy=1), hand.assign(copy=0)])[["label", "copy", *residue.BEHAVIOUR, "template"]]
    out["share"] = out["share"].round(4)
    out.to_csv(Path(__file__).with_name("templates.tsv"), sep="\t", index=False)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
