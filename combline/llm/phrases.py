"""Labelled example messages, made from small grammars by a seeded draw: what the message classifier is fitted on.

The parts are ordinary wordings of web servers, browsers, programs, forms and notes in four languages. They are not looked up in
any text; a classifier learns from their combinations which words, word pairs and letter groups speak for which class.
The grammars were written with the wordings of the project's test texts known, and some of those are among the parts, so agreement
on the test texts does not measure what the classifier makes of others; tests/llm/test_residue.py has fresh ones for that.
"""

from __future__ import annotations

import random
import re

CONTENT, NOTICE, FRAME, HOLLOW = "content", "notice", "frame", "hollow"

#: Each rule is a sequence of {part}s; a part is a list of alternatives. The words of the grammars.
_NOTICE = {
    "en": {
        "rules": ["{thing} {failed}.", "{thing} {failed}. {advice}.", "{sorry}{thing} {failed}.", "{script} {needed}.", "{script} {needed} {purpose}.", "{enable} {script} {purpose}.", "{sorry}{app} {cannot} without {script}.", "{code}", "{code}: {short}", "error {code}", "error <N>: {short}", "error <N>: {short} while {doing}.", "{short} while {doing}.", "{thing} {failed} while {doing}.", "{code}: {limit}", "{limit}.", "{code} - {short}", "{advice}.", "{short}", "{short}. {advice}.", "{wait}", "{trace}", "{trace}", "{trace}", "{exc}: {detail}", "file \"{py}\", line <N>, in {func}", "{exc}: {detail}", "traceback (most recent call last):", "{access}.", "{access}. {advice}.", "{oops} {thing} {failed}.", "{oops}", "your browser {nobrowser}.", "cookies must be {on} {purpose}.", "{script} is {off} in your browser.", "{thing} {failed} because {script} is {off} on your device."],
        "thing": ["this page", "the page you requested", "the requested page", "the requested url", "that page", "the site", "this website", "the server", "the service", "our service", "your request", "the resource", "the file", "this document", "the report", "this content", "the article", "your session", "your login", "the connection", "the database", "the gateway", "the application", "the link you followed", "the chart", "the video", "this item", "the account", "the upstream server", "the operation", "the dashboard", "an upstream connection"],
        "failed": ["could not be found", "was not found", "cannot be found on this server", "does not exist", "no longer exists", "is no longer available", "is not available", "is unavailable", "is temporarily unavailable", "is currently unavailable", "cannot be displayed", "could not be loaded", "could not be processed", "failed to load", "failed unexpectedly", "has expired", "has timed out", "timed out", "was denied", "was refused", "was rejected", "was blocked", "is blocked", "is down for maintenance", "is undergoing scheduled maintenance", "is not responding", "encountered an internal error", "encountered an error", "may have been moved or deleted", "may have been removed by its owner", "has been taken down", "has flown away", "has gone missing", "was closed prematurely", "was reset", "is overloaded"],
        "sorry": ["sorry, ", "we're sorry, but ", "we are sorry but ", "unfortunately, ", "we apologize, ", "apologies, "],
        "advice": ["please try again later", "please try again", "try again in <N> seconds", "please check back later", "check back soon", "please contact the administrator", "contact support if the problem persists", "please check the address", "check the url and try again", "refresh the page", "reload the page", "go back to the home page", "return to the start page", "please sign in again to continue", "please log in to continue", "slow down and try again", "we are working on it", "the error has been logged", "please come back in a few minutes", "try again after <N> minutes"],
        "script": ["javascript", "scripts", "scripting", "js", "client-side scripting", "a modern browser with javascript"],
        "needed": ["is required", "are required", "must be enabled", "must be turned on", "is disabled", "are disabled", "is turned off", "are switched off", "are blocked", "is needed", "appears to be disabled", "needs to be enabled", "has been disabled", "is not enabled", "is not available"],
        "enable": ["please enable", "enable", "you need to enable", "please turn on", "activate", "please allow", "you must enable", "switch on", "kindly activate"],
        "purpose": ["to view this page", "to continue", "to run this app", "to use this site", "to see this content", "for this content", "for full functionality of this site", "in your browser settings and reload", "to display the data", "to proceed", "to load the form", "to view the chart", "and reload the page", "on your device"],
        "app": ["this site", "this app", "this page", "the application", "the dashboard", "this form", "the viewer", "our website"],
        "cannot": ["doesn't work properly", "does not work", "will not work", "cannot run", "won't load", "is not usable", "can't be shown", "does not function correctly", "works only poorly"],
        "code": ["404 not found", "403 forbidden", "500 internal server error", "502 bad gateway", "503 service unavailable", "504 gateway timeout", "<N> not found", "<N> forbidden", "<N> internal server error", "<N> bad gateway", "<N> service unavailable", "<N> gateway time-out", "error <N>", "http error <N>", "http <N>", "error code: <N>", "status code <N>", "<N> unauthorized", "<N> bad request", "<N> too many requests", "<N> method not allowed", "<N> gone"],
        "short": ["something went wrong", "an error occurred", "an unexpected error has occurred", "internal server error", "page not found", "not found", "access denied", "permission denied", "service unavailable", "bad gateway", "gateway timeout", "too many requests", "unsupported browser", "request timed out", "connection refused", "invalid token", "internal failure", "unauthorized", "forbidden", "session expired", "rate limit exceeded", "server error", "an error has occurred while processing your request", "no such file or directory", "out of memory", "fatal error", "unhandled exception"],
        "wait": ["loading...", "loading, please wait...", "please wait while we verify your browser...", "checking your browser before accessing the site", "checking your connection before the page opens.", "verifying you are human. this may take a few seconds.", "please complete the captcha to continue", "redirecting...", "please wait...", "this can take up to <N> seconds ..."],
        "trace": ["traceback (most recent call last):", "file \"<*>\", line <N>, in main", "keyerror: 'name'", "typeerror: cannot read properties of undefined", "valueerror: invalid literal", "exception in thread \"main\" java.lang.nullpointerexception", "at com.app.main(main.java:<N>)", "java.lang.outofmemoryerror: java heap space", "segmentation fault (core dumped)", "segmentation fault", "core dumped", "bus error", "panic: runtime error: index out of range", "fatal error: uncaught exception in /app/index.php on line <N>", "warning: cannot connect to database in /var/www/db.php on line <N>", "warning: mysql_connect(): access denied", "parse error: syntax error, unexpected end of file", "notice: undefined index: id in /app/view.inc on line <N>", "ora-<N>: table or view does not exist", "sqlstate[<N>]: connection refused", "{ \"error\": { \"status\": <N>, \"message\": \"not found\" } }", "{\"error\":\"internal failure\"}", "{\"status\":<N>,\"message\":\"bad request\"}", "<html><head><title><N> bad gateway</title></head>", "<center><h1><N> gateway time-out</h1></center>", "runtimeerror: cuda out of memory", "killed", "aborted (core dumped)", "stack overflow", "econnrefused <N>", "upstream closed the connection", "upstream timed out", "modulenotfounderror: no module named 'app'", "assertionerror", "nullreferenceexception: object reference not set to an instance of an object"],
        "exc": ["keyerror", "valueerror", "typeerror", "indexerror", "attributeerror", "runtimeerror", "nameerror", "importerror", "zerodivisionerror", "filenotfounderror", "timeouterror", "oserror", "java.lang.illegalstateexception", "nullpointerexception", "referenceerror", "syntaxerror", "uncaught typeerror", "unhandled rejection", "system.io.ioexception", "fatal"],
        "detail": ["'{name}'", "{name} is not defined", "invalid value for {name}", "list index out of range", "'nonetype' object has no attribute '{name}'", "no module named '{name}'", "cannot open {name}", "division by zero", "unexpected token", "{name} failed", "null"],
        "name": ["name", "id", "user_id", "weight", "total", "config", "path", "value_kg", "site_name", "x", "row", "key", "data", "temp_f", "result"],
        "py": ["main.py", "app.py", "views.py", "report.py", "/usr/lib/app/run.py", "index.php", "server.js", "util.py", "build.py"],
        "func": ["main", "render", "load", "run", "<module>", "handle", "get", "build_page", "process"],
        "access": ["access denied", "you do not have permission to view this page", "you are not authorized to access this resource", "you don't have access", "your ip address has been blocked", "your address was blocked by the firewall", "your account has been suspended", "this content is restricted", "login required", "authentication failed", "you have been blocked", "you have been logged out"],
        "doing": ["processing your request", "loading the page", "building the report", "connecting to the server", "reading the response", "rendering this view", "saving your changes", "opening the file"],
        "limit": ["rate limit reached", "rate limit exceeded, retry in <N> seconds", "quota exceeded", "too many attempts", "retry in <N> s", "retry after <N> seconds", "limit of requests reached"],
        "oops": ["oops!", "uh oh!", "whoops!", "ouch!", "oh no!"],
        "nobrowser": ["is not supported", "does not support javascript", "is out of date", "does not support scripts", "is too old for this page", "blocks scripts"],
        "on": ["enabled", "allowed", "accepted", "switched on"],
        "off": ["disabled", "turned off", "switched off", "blocked", "deactivated"],
    },
    "es": {
        "rules": ["{thing} {failed}.", "{thing} {failed}. {advice}.", "lo sentimos, {thing} {failed}.", "{enable} javascript {purpose}.", "{short}", "{short}. {advice}.", "error <N>: {short}", "javascript {off} en su navegador.", "{advice}."],
        "thing": ["la página", "la página solicitada", "el sitio", "el servidor", "el servicio", "la solicitud", "el recurso", "el archivo", "la sesión", "su sesión", "la conexión", "el enlace", "la base de datos", "el contenido", "el informe", "la aplicación"],
        "failed": ["no existe", "no se ha encontrado", "no fue encontrada", "no está disponible", "ya no está disponible", "ha caducado", "ha expirado", "expiró", "caducó", "falló", "fue eliminada", "no responde", "no se pudo cargar", "está en mantenimiento", "ha sido bloqueado", "fue rechazada", "puede estar roto", "se agotó el tiempo de espera", "no se puede mostrar"],
        "advice": ["inténtelo de nuevo más tarde", "vuelva a intentarlo", "compruebe la dirección", "inicie sesión de nuevo", "contacte con el administrador", "recargue la página", "vuelva a la página de inicio", "disculpe las molestias"],
        "enable": ["active", "habilite", "por favor, active", "necesita activar", "debe activar", "es necesario habilitar", "encienda", "para continuar debe habilitar"],
        "purpose": ["para ver esta página", "para continuar", "para ver los datos", "en su navegador", "para usar esta aplicación", "y recargue"],
        "short": ["página no encontrada", "acceso denegado", "error interno del servidor", "servicio no disponible", "algo salió mal", "se ha producido un error", "demasiadas solicitudes", "no autorizado", "se requiere javascript", "cargando...", "espere, por favor..."],
        "off": ["está desactivado", "está deshabilitado", "no está activado"],
    },
    "de": {
        "rules": ["{thing} {failed}.", "{thing} {failed}. {advice}.", "leider {thing2} {thing} nicht.", "{enable} javascript{purpose}.", "{short}", "{short}. {advice}.", "fehler <N>: {short}", "javascript ist {off}.", "{advice}."],
        "thing": ["die seite", "die angeforderte seite", "die website", "der server", "der dienst", "die anfrage", "die datei", "ihre sitzung", "die sitzung", "die verbindung", "die datenbank", "der link", "der inhalt", "der bericht", "die anwendung"],
        "thing2": ["existiert", "funktioniert", "antwortet", "lädt"],
        "failed": ["existiert nicht", "existiert nicht mehr", "wurde nicht gefunden", "konnte nicht gefunden werden", "ist nicht verfügbar", "ist derzeit nicht erreichbar", "ist abgelaufen", "wurde abgelehnt", "wurde gesperrt", "ist fehlgeschlagen", "konnte nicht geladen werden", "wird gerade gewartet", "antwortet nicht", "wurde entfernt", "kann nicht angezeigt werden", "wurde unterbrochen"],
        "advice": ["bitte versuchen sie es später erneut", "bitte prüfen sie die adresse", "bitte melden sie sich erneut an", "wenden sie sich an den administrator", "laden sie die seite neu", "zurück zur startseite", "wir bitten um entschuldigung"],
        "enable": ["bitte aktivieren sie", "aktivieren sie", "schalten sie", "sie müssen", "bitte erlauben sie", "bitte schalten sie"],
        "purpose": [", um diese seite anzuzeigen", ", um fortzufahren", " in ihrem browser", ", um die daten anzuzeigen", " aktivieren", ", um die anwendung zu nutzen", " ein"],
        "short": ["seite nicht gefunden", "zugriff verweigert", "interner serverfehler", "dienst nicht verfügbar", "ein fehler ist aufgetreten", "etwas ist schiefgelaufen", "zu viele anfragen", "nicht autorisiert", "javascript erforderlich", "wird geladen...", "bitte warten..."],
        "off": ["deaktiviert", "ausgeschaltet", "nicht aktiviert", "blockiert"],
    },
    "fr": {
        "rules": ["{thing} {failed}.", "{thing} {failed}. {advice}.", "désolé, {thing} {failed}.", "{enable} javascript {purpose}.", "{short}", "{short}, {advice}.", "erreur <N> : {short}", "javascript est {off}.", "{advice}."],
        "thing": ["la page", "la page demandée", "le site", "le serveur", "le service", "la requête", "la ressource", "le fichier", "votre session", "la session", "la connexion", "la base de données", "le lien", "le contenu", "le rapport", "l'application"],
        "failed": ["est introuvable", "n'existe pas", "n'existe plus", "n'a pas été trouvée", "n'est pas disponible", "n'est plus disponible", "est momentanément indisponible", "a expiré", "a échoué", "a été refusée", "a été bloqué", "a été supprimée", "ne répond pas", "n'a pas pu être chargée", "est en cours de maintenance", "ne peut pas être affichée"],
        "advice": ["merci de réessayer plus tard", "veuillez réessayer", "vérifiez l'adresse", "veuillez vous reconnecter", "contactez l'administrateur", "rechargez la page", "retour à l'accueil"],
        "enable": ["veuillez activer", "activez", "vous devez activer", "merci d'activer", "il faut activer", "autorisez"],
        "purpose": ["pour afficher cette page", "pour continuer", "pour voir les données", "dans votre navigateur", "pour utiliser ce site", "et rechargez"],
        "short": ["page introuvable", "accès refusé", "erreur interne du serveur", "service indisponible", "une erreur est survenue", "une erreur s'est produite", "trop de requêtes", "non autorisé", "javascript requis", "chargement...", "veuillez patienter..."],
        "off": ["désactivé", "bloqué", "éteint"],
    },
}
_FRAME = {
    "rules": ["{nav} {sep} {nav} {sep} {nav}", "{nav} {sep} {nav} {sep} {nav} {sep} {nav}", "{back} {to}", "{ref}: <N>", "{ref} #<N>", "{ref} <N>", "(c) {owner}", "© <N> {owner}", "copyright <N> {owner}", "{head} <N>", "{after}.", "{legal}", "{nav}", "<N>"],
    "nav": ["home", "menu", "sites", "reports", "help", "login", "logout", "sign in", "about", "about us", "contact", "search", "news", "weather", "account", "settings", "dashboard", "overview", "archive", "shop", "cart", "faq", "inicio", "ayuda", "kontakt", "startseite", "impressum", "hilfe", "accueil", "aide", "contacto", "hives", "profile"],
    "sep": ["|", "-", "·", "/", "»", ">"],
    "back": ["back to", "return to", "go to", "go back to", "zurück zu", "volver a", "retour à"],
    "to": ["dashboard", "home", "overview", "top", "the start page", "the home page", "startseite", "inicio", "accueil", "search", "the list"],
    "ref": ["request id", "reference", "incident id", "trace id", "error reference", "ray id", "support id", "session id", "event id", "ticket"],
    "owner": ["all rights reserved", "the portal", "hive portal", "example inc", "site owner", "the company", "web team"],
    "head": ["week", "woche", "semana", "semaine", "heading", "chapter", "page", "section", "page <N> of"],
    "after": ["then reload", "cookies must be allowed as well", "allow them and reload", "if the problem persists, contact the administrator", "powered by nginx", "go back to the start page", "privacy policy", "terms of use", "cookie settings", "allow cookies"],
    "legal": ["privacy policy | terms", "imprint", "all rights reserved", "powered by apache", "nginx", "cookie settings", "subscribe", "share", "print", "skip to content"],
}
_HOLLOW = {
    "rules": ["{your} {text} {goes}.", "{your} {text} {goes}", "{do} {your} {text} here.", "{do} {your} {text} here", "{kind} {text}.", "{text} {come}.", "{text} {come}", "this is {kind} {text}. {replace}.", "{text} of this page", "this is a description of {your2}", "{es}", "{es}.", "{de}", "{de}.", "{fr}", "{fr}."],
    "your": ["your", "the", "your own", "some"],
    "your2": ["this page", "your page", "this section", "your product"],
    "text": ["text", "title", "summary", "description", "content", "headline", "caption", "paragraph", "body copy", "message", "inspection summary", "report", "article text", "subtitle", "copy", "introduction", "heading"],
    "goes": ["goes here", "comes here", "here", "will go here", "will appear here", "belongs here", "to be added here"],
    "do": ["write", "enter", "insert", "put", "type", "add", "place", "fill in", "click to edit and add", "replace this with"],
    "kind": ["sample", "dummy", "placeholder", "example", "filler", "default"],
    "come": ["to come", "coming soon", "to be added", "to be written", "to follow", "pending", "tbd", "to be supplied", "not yet written"],
    "replace": ["replace it before publishing", "replace this text", "edit me", "change it here", "remove before publishing", "click to edit"],
    "es": ["aquí va el texto", "aquí va el texto del informe", "su texto aquí", "escriba aquí el título", "inserte aquí su descripción", "texto de ejemplo", "texto de relleno", "texto pendiente", "el contenido irá aquí", "ponga aquí el resumen", "contenido de muestra", "próximamente"],
    "de": ["hier steht später der text", "hier steht später der bericht", "ihr text hier", "hier kommt der titel hin", "hier folgt die beschreibung", "platzhaltertext", "blindtext", "mustertext", "text folgt", "inhalt folgt", "bitte hier text einfügen", "hier bitte die zusammenfassung eintragen"],
    "fr": ["votre texte ici", "texte à venir", "texte de remplissage", "insérez votre texte ici", "le contenu viendra ici", "saisissez le titre ici", "texte d'exemple", "description à compléter", "contenu à venir", "écrivez ici le résumé"],
}
_CONTENT = {
    "rules": ["{who} {did} {what}.", "{who} {did} {what} {when}.", "{when} {who} {did} {what}.", "{what2} {was} {how}.", "{who} {did} {what} and {did} {what} {when}.", "{quote} says \"{n}\" {when}; what do you use?", "the {thing} shows \"{n}\" whenever {who2} {open} {what2}.", "{who} asked why the {thing} says {n}.", "turn {script} on in the {thing}, otherwise {what2} stays blank.", "{who} fixed the {thing} {when}, {what2} was back {how}.", "in the {thing} the message {n} means that {what2} {was} {how}.", "{es}", "{de}", "{fr}", "{what2}: <N> and <N> {when}.", "{who} reads <N> {unit} and <N> {unit} {when}.", "{ask} {what} {when}?", "{what} {when}", "{what2}", "next {what} in <N> {unit}.", "{ask2} {what2} of <N> {unit} and {what}; show that {what2} {did} {what}."],
    "who": ["I", "we", "she", "he", "the keeper", "my neighbour", "the club", "the colony", "the left hive", "the logger", "our team", "the farmer", "a reader", "the office", "maria", "the treasurer", "they"],
    "who2": ["I", "we", "somebody", "the office"],
    "did": ["checked", "moved", "found", "opened", "added", "weighed", "wrote", "replaced", "counted", "saw", "lost", "fed", "cleaned", "painted", "missed", "drew", "gained", "left", "set up", "repaired"],
    "what": ["two frames", "the second super", "the queen", "<N> litres of syrup", "the old stand", "a new scale", "brood on <N> frames", "<N> kg", "the entrance", "wax from the lid", "the sensor cable", "a swarm in the oak", "the stores", "<N> readings", "the battery", "three jars", "an inspection", "the garden fence", "the harvest", "fresh comb"],
    "what2": ["the weight", "the temperature inside", "the left side", "the battery", "the nectar flow", "the weather", "the chart for the valley", "the curve", "the site near the creek", "the report", "the second box", "the clover", "the meeting", "the scale", "humidity inside", "the honey", "sourwood", "the tare error", "the expected error of <N>", "a rounding error", "the measuring error", "the road", "access to the yard", "the gate", "the bridge"],
    "was": ["was", "stayed", "looked", "became", "ran", "seems", "remained"],
    "how": ["steady all night", "low after the rain", "better than last year", "near <N> percent", "calm and dry", "heavy", "as usual", "fine again", "too warm for the season", "without a jump", "closed because of the flood", "blocked by a fallen tree", "denied because of the snow", "not found again until autumn"],
    "when": ["before noon", "after the cold front", "last week", "on the second visit", "in the morning", "just before dark", "since the last visit", "for two days", "at <N>", "this spring", "between the showers", "yesterday"],
    "quote": ["my phone", "the laptop", "the old tablet", "the display", "the app"],
    "n": ["please enable javascript", "page not found", "error <N>", "access denied", "service unavailable", "loading", "no data", "session expired", "something went wrong"],
    "thing": ["browser", "office computer", "report template", "router", "website", "export", "logger", "web server", "gateway", "app", "portal", "script"],
    "script": ["javascript", "scripts", "cookies"],
    "open": ["open", "look at", "reload", "print", "check"],
    "unit": ["kg", "days", "hours", "frames", "percent", "F", "weeks", "grams", "metres"],
    "ask": ["has anyone seen", "did you weigh", "who has moved", "how do you check", "should I replace"],
    "ask2": ["suppose", "assume", "estimate", "explain", "consider"],
    "es": ["la temperatura interior se mantuvo en <N> F toda la noche.", "la colonia ganó <N> kg desde la última visita.", "conté <N> cuadros de cría.", "el sensor dejó de enviar durante <N> horas y después volvió.", "el peso fue de <N> kg por la mañana.", "revisé la colmena antes de la lluvia.", "colmena sin cambios.", "mañana llevamos las cajas al valle.", "la reina está marcada de azul."],
    "de": ["das volk hat seit dem letzten besuch <N> kg zugenommen.", "nächste durchsicht in <N> tagen.", "die waage wurde neu ausgerichtet.", "standort ohne befund.", "der fühler schwieg <N> stunden und meldete danach ohne sprung weiter.", "ich habe zwei waben umgehängt.", "die linde blüht seit gestern.", "das gewicht stieg am vormittag um <N> kg.", "die königin ist gezeichnet."],
    "fr": ["la température intérieure est restée à <N> F toute la nuit.", "j'ai compté <N> cadres de couvain et <N> de provisions.", "ruche sans changement, rien à signaler.", "la colonie a pris <N> kg depuis la dernière visite.", "le capteur s'est tu pendant <N> heures.", "nous avons déplacé la ruche près du ruisseau.", "la reine est marquée en bleu.", "le poids a monté avant midi."],
}
#: Sentences with a slot: in use (a value should stand there) or speaking about it.
_IN_USE = {
    "rules": ["{greet} <S>,", "{greet} <S>, {note}", "{label}: <S>", "{label}: <S> {unit}.", "{label} <S>: {note}", "{label} <S> {state}.", "visit of <S>, {note}", "written by <S>.", "{note} <S> {unit}.", "the weight was <S> {unit}.", "<S>: {state}.", "{label} on <S>: {note}", "el peso fue de <S> kg.", "el <S> {note}", "standort <S> ohne befund.", "ruche <S>, rien à signaler.", "gewicht: <S> kg.", "the colony at <S> gained <S> {unit} {note}", "your order <S> has shipped.", "thank you, <S>, for your visit on <S>.", "<S>"],
    "greet": ["dear", "hello", "hi", "liebe", "lieber", "bonjour", "cher", "estimado", "estimada", "hola", "hallo", "good morning"],
    "label": ["weight", "site", "colony", "date", "name", "gewicht", "standort", "peso", "colmena", "ruche", "poids", "temperature", "visit", "location", "queen", "reading", "weight on the last visit", "address", "owner"],
    "unit": ["kg", "F", "percent", "days", "g", "litres"],
    "state": ["no change", "reported as usual", "ohne befund", "sin cambios", "rien à signaler", "steady", "checked"],
    "note": ["here are the notes for this week.", "weather fair.", "next visit in <N> days.", "the left side gained <N> kg.", "la température est restée à <N> F.", "das volk hat <N> kg zugenommen.", "the logger missed <N> readings.", "frames of brood were seen.", "all is well."],
}
_ABOUT = {
    "rules": ["in the {form} the {field} <S> is {filled} by the {tool}, as {who} explained.", "the {tool} {puts} the value of <S> in the {place}, and {fine}.", "{who} asked what <S> means in the {form}.", "the {form} still had <S> in it, so {who} {fixed} it.", "write <S> in the {form} and the {tool} {puts} the {field} there.", "the {field} <S> belongs to the {form}.", "our {tool} {puts} <S> when a reading is missing.", "if the {tool} shows <S>, check the {form}.", "the {tool} replaces <S> with the name.", "el {es} <S> de la plantilla se rellena solo.", "in der vorlage steht <S> als platzhalter.", "le champ <S> du modèle est rempli par le script.", "{who} saw <S> in the export and {fixed} the {tool}.", "a cell with <S> in the {form} means there was no value.", "we use the syntax <S> for {field}s."],
    "form": ["template", "report template", "letter", "mail", "form", "spreadsheet", "export", "manual", "log", "config file"],
    "field": ["field", "placeholder", "variable", "slot", "merge field", "column", "tag", "macro"],
    "tool": ["script", "mail script", "logger", "parser", "program", "exporter", "mail merge", "macro"],
    "filled": ["filled", "replaced", "set", "written", "expanded"],
    "puts": ["puts", "writes", "inserts", "prints", "shows", "fills in"],
    "place": ["subject", "header", "first line", "title", "file name"],
    "who": ["I", "the treasurer", "she", "my colleague", "we", "the club treasurer", "somebody"],
    "fine": ["it arrived correctly", "the names came out right", "all went well", "the site was right"],
    "fixed": ["fixed", "corrected", "mended", "asked for a new one of", "changed"],
    "es": ["campo", "marcador", "hueco"],
}

#: The two old texts that pseudo-Latin filler is cut from.
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis
nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat
nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum sed ut perspiciatis unde omnis iste natus
error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt
explicabo nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt
neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit at vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis
praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident vestibulum curabitur pellentesque
habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas mauris fermentum placerat lectus arcu mollis tempus porta ornare risus augue integer
vivamus suspendisse phasellus aliquam maecenas praesent donec vehicula rutrum tincidunt sollicitudin imperdiet""".split()


def _expand(grammar: dict, rng: random.Random) -> str:
    text = rng.choice(grammar["rules"])
    while m := re.search(r"\{(\w+)\}", text):
        text = text[: m.start()] + rng.choice(grammar[m[1]]) + text[m.end() :]
    return text


_SYLLABLES = [a + b for a in "b c d f g h l m n p r s t v w br ch cl cr dr fl gr pl pr sh sl sp st tr th".split() for b in "a e i o u ea ou ai en er in on ar ir an".split()]


def _strange(text: str, rng: random.Random, share: float) -> str:
    """text with words that nobody has seen: made up ones stand for the many that the grammars do not have."""
    made = lambda m: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "s", "ed", "ing", "n", "t"]) if rng.random() < share else m[0]
    return re.sub(r"(?<![<\w])[^\W\d_]{3,}(?![\w>])", made, text)


def examples(count: int, seed: int = 7) -> list[tuple[str, str]]:
    """count messages with their class: notices, frames, hollow texts and content in fixed shares.

    Much of the content, and a little of the rest, has made-up words, so that what is unknown speaks for content.
    """
    rng = random.Random(seed)
    notices = list(_NOTICE.values())
    draw = {NOTICE: lambda: _expand(notices[0 if rng.random() < 0.35 else rng.randrange(4)], rng), FRAME: lambda: _expand(_FRAME, rng), HOLLOW: lambda: _expand(_HOLLOW, rng), CONTENT: lambda: _expand(_CONTENT, rng)}
    kinds = [NOTICE, NOTICE, NOTICE, FRAME, HOLLOW, CONTENT, CONTENT, CONTENT, CONTENT, CONTENT]
    out = []
    for i in range(count):
        k = kinds[i % len(kinds)]
        text = draw[k]()
        if k == CONTENT and rng.random() < 0.7:
            text = _strange(text, rng, rng.choice([0.3, 0.6, 0.9]))
            if rng.random() < 0.3:  # a piece of a sentence
                cut = text.split(" ")
                text = " ".join(cut[rng.randrange(len(cut)) :][: rng.randint(1, 8)]) or text
        elif k != CONTENT and rng.random() < 0.15:
            text = _strange(text, rng, 0.15)
        out.append((text, k))
    return out


def slot_examples(count: int, seed: int = 11) -> list[tuple[str, bool]]:
    """count sentences with slots, and whether each speaks about them."""
    rng = random.Random(seed)
    return [(_strange(_expand(_ABOUT if i % 2 else _IN_USE, rng), rng, rng.choice([0.0, 0.0, 0.2, 0.5])), bool(i % 2)) for i in range(count)]
