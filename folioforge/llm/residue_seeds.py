"""Training examples of the residue models (problem 3), from public knowledge only.

Nothing here is taken from the tables that are searched (standard phrases such as
"404 Not Found" stand in both): status phrases come from the HTTP standard as Python
ships it, the filler is the typesetters' passage and what
common editors put in by default, notices are those of widely used servers, site
builders and JavaScript tool kits and their usual translations, and placeholders are
built from the syntax rules of template languages.  ``Q`` stands for a name.
"""

from __future__ import annotations

import random
import re
from http import HTTPStatus

NAMES = "page report garden account invoice ticket shop video profile article member forum street river letter camera recipe lesson museum station".split()

#: Classical filler and what editors and site builders insert by default.
FILLER = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.",
    "Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae. Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Curabitur augue massa, felis vitae nulla porttitor.",
    "The quick brown fox jumps over the lazy dog. The quick brown fox jumps over the lazy dog.", "xxx xxxx xxxxx xx xxxxxx xxx. Xxxxx xxxx xxx xxxxxxx.", "asdf asdf qwerty asdf jkl test test test 1234 1234 foo bar baz foo bar baz qwer zxcv",
    "This is an example page. It's different from a blog post because it will stay in one place. As a new user, you should delete this page and create new pages for your content.",
    "Welcome to your new site. This is your first post. Edit or delete it, then start writing!", "This is a sample text. Replace it with your own text. Your content goes here. Add your text here. Click here to edit this text.",
    "Insert your text here. Your title here. Your description here. Placeholder text. Dummy text. Sample text. Example text goes here.", "Content coming soon. This page is under construction. Please check back later. Coming soon. Stay tuned.", "We are working on this page. More content will be added soon.",
    "Blindtext. Dies ist ein Typoblindtext. Hier steht später der richtige Text. Platzhaltertext, bitte ersetzen. Hier kommt der Inhalt. Die Seite befindet sich im Aufbau.",
    "Faux texte. Texte de remplissage, à remplacer. Votre texte ici. Page en construction, contenu à venir prochainement.", "Texto de ejemplo. Texto de relleno. Su texto aquí. Página en construcción. Próximamente más contenido.",
    "Testo di esempio. Inserisci qui il tuo testo. Pagina in costruzione.", "Texto de exemplo. Insira seu texto aqui. Página em construção. Em breve.", "Текст-заполнитель. Здесь будет текст. Страница находится в разработке. Скоро здесь появится содержание.",
    "ダミーテキストです。ここに本文が入ります。サンプルテキスト。準備中です。", "这里是占位文字。示例文本。页面建设中,敬请期待。",
)

#: Default error and access pages of common servers, run times and gateways.
ERROR = (
    "The requested URL was not found on this server.", "The page you are looking for could not be found. It may have been moved or deleted. Return to the home page.", "Sorry, this page isn't available. The link you followed may be broken, or the page may have been removed.",
    "Oops! That page can't be found. It looks like nothing was found at this location.", "Page not found. We couldn't find what you were looking for.", "404 page not found", "404 Not Found\n\nnginx/1.18.0", "403 Forbidden\n\nApache/2.4.41 Server at Q Port 80", "502 Bad Gateway\n\nopenresty", "Error 404: file or directory not found.",
    "Access Denied. You don't have permission to access this resource on this server.", "You are not authorized to view this page. Please contact the administrator.", "Authentication required. Please log in to continue.", "Your session has timed out. Please sign in again.", "You must be logged in to view this content.",
    "The server encountered an internal error or misconfiguration and was unable to complete your request.", "Something went wrong. Please try again later.", "An unexpected error has occurred. Error code: 500", "The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.",
    "Briefly unavailable for scheduled maintenance. Check back in a minute.", "We are currently down for maintenance. We will be back soon. Thank you for your patience.", "The service is unavailable. Please try again in a few minutes.", "The upstream server did not respond in time. Gateway timeout error.",
    "Error establishing a database connection", "Could not connect to the database server.", "There has been a critical error on this website.", "You have exceeded the request limit. Too many requests from your address. Please slow down and try again in 60 seconds.", "You have been rate limited. Please wait before retrying.",
    "Please verify you are a human. Checking if the site connection is secure. This process is automatic. Your browser will redirect shortly. Ray ID: 5f2b91", "Please complete the security check to access Q. Prove that you are not a robot.", "Attention required! You have been blocked. Request ID: 8812345", "Reference #18.2d351ab8 Incident ID: 2231",
    "Traceback (most recent call last):\n  File \"/srv/Q.py\", line 31, in <module>\n    main()\nKeyError: 'Q'", "Traceback (most recent call last):\n  File \"app.py\", line 7, in index\nTypeError: 'NoneType' object is not iterable", "Exception in thread \"main\" java.lang.NullPointerException\n\tat com.example.Q.main(Q.java:15)",
    "Fatal error: Uncaught Error: Call to undefined function Q() in /var/www/html/index.php on line 12", "Warning: Undefined variable $Q in /var/www/html/Q.php on line 3", "Fatal error: Uncaught TypeError: Argument #1 ($Q) must be of type string, null given in /home/Q/functions.php:88", "Fatal error: Allowed memory size exhausted in /srv/Q/index.php on line 40",
    "No such file or directory: Q", "No such key: the specified key does not exist.", "NoSuchKey The specified key does not exist.", "Item not found: Q", "No results found for Q.", "This record does not exist: Q",
    "Fehler 404. Die Seite wurde nicht gefunden. Die angeforderte Seite existiert nicht.", "Zugriff verweigert. Ein interner Fehler ist aufgetreten. Bitte versuchen Sie es später erneut.", "Erreur 404. Page introuvable. La page demandée n'existe pas ou a été supprimée.", "Accès refusé. Une erreur est survenue. Veuillez réessayer plus tard.",
    "Error 404. Página no encontrada. Lo sentimos, la página que busca no existe.", "Acceso denegado. Se ha producido un error interno. Inténtelo de nuevo más tarde. Código de error: 500", "Erro 404. Página não encontrada. Desculpe, a página não existe. Ocorreu um erro interno do servidor.", "Errore 404. Pagina non trovata. Accesso negato.",
    "Ошибка 404. Страница не найдена. Запрашиваемая страница не существует.", "Доступ запрещён. Внутренняя ошибка сервера. Код ошибки: 500", "404 エラー。お探しのページは見つかりませんでした。アクセスが拒否されました。サーバーエラーが発生しました。", "404 错误。找不到页面。您访问的页面不存在。拒绝访问。服务器内部错误。",
)

#: Notices that scripts are needed: defaults of tool kits, of sites and of browsers' help, with translations.
SCRIPT = (
    "You need to enable JavaScript to run this app.", "We're sorry but Q doesn't work properly without JavaScript enabled. Please enable it to continue.", "Please enable JavaScript to continue using this application.", "JavaScript is required to view this page.", "This site requires JavaScript. Please turn on JavaScript in your browser settings and reload the page.",
    "Your browser does not support JavaScript or it is disabled.", "JavaScript is disabled in your browser. Some features of Q will not work.", "It looks like JavaScript is turned off. Enable scripts in your browser to see this content.", "Sorry, you need a browser that supports JavaScript. Please upgrade your browser.", "Your browser is out of date and is not supported. Update your browser to view Q.",
    "This content cannot be displayed without scripts. Scripts are blocked by your browser or an extension.", "Loading... If the page does not load, check whether your browser or an ad blocker blocks our scripts.", "Loading, please wait... Please enable JavaScript if this page does not load.", "noscript: this application needs scripts to be enabled.", "This website works best with JavaScript switched on.",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite anzuzeigen. Diese Anwendung benötigt JavaScript.", "Veuillez activer JavaScript dans votre navigateur pour afficher cette page. Ce site nécessite JavaScript.", "Por favor, active JavaScript en su navegador para ver esta página. Este sitio requiere JavaScript. Debe habilitar JavaScript.", "Ative o JavaScript no seu navegador para ver esta página. É necessário habilitar o JavaScript.",
    "Per visualizzare questa pagina è necessario abilitare JavaScript.", "Для работы сайта необходимо включить JavaScript в браузере. Включите поддержку сценариев.", "このページを表示するには、ブラウザの JavaScript を有効にしてください。スクリプトが無効になっています。", "请在浏览器中启用 JavaScript 以查看此页面。",
)

#: What is written where something is still to be filled in.
MARKS, DEEDS = ("TODO", "TBD", "FIXME", "XXX"), ("fill in", "add", "write", "insert", "replace", "complete", "describe", "update")

#: Opening and closing signs of substitutions: Mustache, Jinja and Liquid; shell, JSP and script literals; Ruby; ERB and EJS; Template Toolkit;
#: wiki markup; percent formats; doubled signs of merge fields; documentation conventions. Variables of shells (`%X%`, `$X`) are no substitutions of a page.
BRACKETS = (
    ("{{ ", " }}"), ("{{", "}}"), ("{{{", "}}}"), ("{% ", " %}"), ("${", "}"), ("#{", "}"), ("{", "}"), ("<%= ", " %>"), ("<% ", " %>"), ("[% ", " %]"), ("[[", "]]"), ("%(", ")s"), ("%%", "%%"), ("@@", "@@"),
    ("<", ">"), ("__", "__"), ("[INSERT ", "]"), ("[insert ", " here]"), ("[YOUR ", "]"), ("<your-", ">"),
)
_JOINTS = ("", "_", ".", "-", ":", " ")


def _name(rng: random.Random, capital: bool, spaced: bool) -> str:
    joint = rng.choice(_JOINTS if spaced else _JOINTS[:-1])
    name = rng.choice(NAMES) + (joint + rng.choice(NAMES) if joint else "")
    return name.upper() if capital else name


def placeholders(count: int, rng: random.Random) -> list[str]:
    """Sentences, titles and lines with substitutions in them; their shape alone is learned."""
    out = []
    for _ in range(count):
        words = []
        for _ in range(rng.randint(1, 14)):
            if rng.random() < 0.3:
                left, right = rng.choice(BRACKETS)
                word = left + _name(rng, left in ("@@", "%%", "__", "[INSERT ", "[YOUR ") and rng.random() < 0.8, left[0] == "[") + right
            else:
                word = rng.choice(NAMES)
                word = word.capitalize() if rng.random() < 0.2 else word
            words.append(word + rng.choice(("", "", "", "", "", ",", ".", ":", ";", " |", " -", "\n", ")")))
        out.append(" ".join(words))
    return out


def seeds(copies: int = 6) -> dict[str, list[str]]:
    """The examples by class, with names filled in (the same on every call)."""
    rng = random.Random(42)
    fill = lambda t: re.sub(r"Q", lambda _: rng.choice(NAMES), t)
    status = [f"{s.value} {s.phrase}. {s.description}" for s in HTTPStatus if s.value >= 400] + [f"Error {s.value}: {s.phrase}" for s in HTTPStatus if s.value >= 400]
    out = {"filler": FILLER, "error": (*ERROR, *status), "script": SCRIPT}
    out = {k: [fill(t) for t in v for _ in range(copies)] for k, v in out.items()}
    out["filler"] += [t.upper() for t in FILLER[:3]]
    out["named"] = [f"{m}{s} {d} {rng.choice(NAMES)}" for m in MARKS for d in DEEDS for s in (":", "") for _ in range(copies)]
    out["placeholder"] = placeholders(600 * copies, rng)
    return out
