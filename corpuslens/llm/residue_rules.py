"""Trusted labels of residue: a small set of signs that hold without any context. All other wording is reached from them."""

from __future__ import annotations

_NAME = r"[\p{L}_][\p{L}\p{N}_.\- ]*"
#: Unfilled placeholders, by the delimiters of usual template languages, of any length. Control tokens such as <|endoftext|> are none.
PLACEHOLDER = (
    rf"\{{\{{[^{{}}\n]+\}}\}}|[$#]\{{{_NAME}\}}|<%[^%\n]+%>|\{{%[^%\n]+%\}}|\[\[\s?{_NAME}\s?\]\]|##{_NAME}##|@@{_NAME}@@|<<{_NAME}>>|\{{[\p{{L}}_][\p{{L}}\p{{N}}_.]+\}}|%%{_NAME}%%|%[\p{{Lu}}_]{{3,}}%|__[\p{{Lu}}_]{{3,}}__"
    rf"|\[(?i:your |ihr |ihre |votre |insert |hier )[^\[\]\n]*\]|\[[^\[\]\n]*(?i: einfügen| einsetzen| here| insérer| ici)\]"
)
_QUOTES = "„“”\"«»‚‘’'›‹"
#: A placeholder that a text quotes stands between quotation marks.
QUOTED_PLACEHOLDER = rf"[{_QUOTES}]\s*(?:{PLACEHOLDER})\s*[{_QUOTES}]"
#: What a text quotes, speaks about: left out before signs are looked for.
QUOTED = r"„[^„“”\n]*[“”]|“[^“”\n]*”|«[^«»\n]*»|\"[^\"\n]*\""
#: The words of the classical filler passage. What generators mix with them is learned from the corpus.
PASSAGE = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat"
    " duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
#: Reason phrases of HTTP status codes in English, German and French. Beside a status code they are an error message.
PHRASES = r"(?:not found|bad gateway|bad request|forbidden|unauthorized|internal server error|service (?:temporarily )?unavailable|gateway time-?out|request time-?out|too many requests|access denied|(?:seite )?nicht gefunden|zugriff verweigert|interner serverfehler|page introuvable|non trouvée|accès refusé|erreur interne)"
ERROR = rf"(?i)(?<!\d)[1345]\d\d(?!\d)\W{{0,4}}(?:error\W{{0,3}})?{PHRASES}|{PHRASES}\W{{0,3}}(?:error |fehler |erreur |code )?[1345]\d\d(?!\d)|^[45]\d\d: |^checking your browser\b"
#: A demand for scripts names them and, in the same clause, how to switch them on, or that they are off or needed; plain scripts are meant only beside a browser, a site or a page.
_SWITCH = r"\b(?:enabled?|disabled|turn(?:ed)? o(?:n|ff)|activate|requires?|required|needs?|blocks?|blocked|aktivier\w*|deaktivier\w*|(?:ein|an|aus)(?:ge)?schalte\w*|benötigt|blockier\w*|activer|activez|désactivé\w*|nécessaire)\b"
_CLAUSE = r"[^;:.!?]*"
_ADDRESS = r"(?=.*\b(?:bitte|please|veuillez|your|you|ihr\w*|sie|votre|vous|browser|site|page|seite|muss|must|is|ist|wird|ohne|without|sans|bei)\b)"
SCRIPT = rf"(?i)^{_ADDRESS}(?:.*java ?script{_CLAUSE}{_SWITCH}|.*{_SWITCH}{_CLAUSE}java ?script)|^(?={_CLAUSE}\bs[ck]ripte?n?s?\b)(?={_CLAUSE}{_SWITCH}){_CLAUSE}\b(?:browser|site|page|seite)\b"
#: A text of nothing but one word, three times or more, and texts that call themselves filler.
REPEATED = r"(?i)^(\p{L}{3,})(?:\W+\1){2,}\W*$"
SELF_NAMED = r"(?i)^(?:dies ist (?:nur )?ein (?:blind|platzhalter)text|this is (?:a )?(?:dummy|placeholder|sample) text|ceci est un (?:faux )?texte)\b[^.!?]*[.!]?$"
