"""Held-out wordings: texts written after the rules and exemplars were finished, used for measuring only."""

import pytest

from loomlake.llm import answers, residue
from tests.llm.fixtures import message, samples

RESIDUE = [
    "Dear {{ first_name }}, thank you for your order.", "Hello %%FIRSTNAME%%, we miss you!", "Hi *|FNAME|*, your statement is ready.", "Sehr geehrter Herr {Nachname}, Ihr Termin steht fest.", "Estimada [NOMBRE DEL CLIENTE]: adjuntamos su contrato.",
    "Total due: ${amount_due} by ${due_date}.", "Your code is <verification_code>.", "Meeting on [DATE] at [TIME].", "Signature: ________________", "Valid until: MM/DD/YYYY", "Card number XXXX-XXXX-XXXX", "TODO: describe the refund process", "Price: TBD",
    "The fee is [insert fee] per month.", "<!-- TODO replace with real text -->\nOur fees", "Welcome back, undefined!\nBalance: undefined", "Score: NaN%", "Last login: Invalid Date", "Owner: [object Object]", "Rate: #DIV/0!", "Hello null, you have new mail.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "Sed ut perspiciatis lorem ipsum dolor sit amet consectetur.", "Click here to add a subtitle\nAdd your text here", "This is dummy text. Replace it with your own content.", "blah blah blah blah blah blah blah",
    "abcabcabcabcabcabcabcabc", "Hier steht Blindtext. Blindtext ist Platzhaltertext.", "Zupiter calenda morvin sestra polvent duntas. Calenda morvin bestula sortem duntas pravel. Sestra pravel zupiter.", "Testtext Testtext Testtext Testtext Testtext Testtext",
    "404 - Page not found", "Error 503: Service Unavailable", "500 Internal Server Error\nThe server encountered an error.", "Access to this page has been denied.", "You don't have permission to access this resource.", "The page you are looking for doesn't exist. Return to the home page.",
    "Your session has timed out. Please log in again.", "Too many requests. Please try again later.", "Sorry, something went wrong. Try again in a few minutes.", "We'll be back soon. The site is down for scheduled maintenance.", "Please verify you are a human by completing the captcha.",
    "Checking if the site connection is secure", "Seite konnte nicht gefunden werden. Zurück zur Startseite.", "Ein unerwarteter Fehler ist aufgetreten. Bitte versuchen Sie es später erneut.", "La página solicitada no existe.", "Acceso denegado: no tiene permiso para ver esta página.",
    "Une erreur est survenue. Veuillez réessayer plus tard.", "Vous n'avez pas accès à cette page.", "服务器错误，请稍后重试。", "Exception in thread \"main\" java.lang.IllegalStateException\n\tat com.acme.App.main(App.java:10)",
    "Traceback (most recent call last):\n  File \"x.py\", line 3, in <module>\nZeroDivisionError: division by zero", "Enable JavaScript and cookies to continue", "JavaScript must be enabled in order to use this application.", "You need JavaScript to run this app.", "Bitte schalten Sie JavaScript in Ihrem Browser ein.",
    "Para ver esta página active JavaScript en su navegador.", "Veuillez activer JavaScript pour accéder au site.", "Your browser has JavaScript turned off.", "请在浏览器中启用 JavaScript。", "DNS_PROBE_FINISHED_NXDOMAIN",
]
SOUND = [
    "The bank was founded in 1904 and has forty branches.", "Please bring your passport [or an identity card] to the branch.", "He wrote [sic] on every page.", "See note [1] and note [2] below.", "The rate (p.a.) is 3%.", "Dates are written as DD.MM.YYYY in our letters.",
    "Use the format MM/YY for the expiry date.", "A TODO list keeps track of open cases.", "Monthly fee: None", "None of the accounts was closed.", "A null hypothesis is rejected when the evidence is strong.", "Undefined terms have the meaning given in clause 4.", "Nan was my grandmother's name.",
    "Our letters use the placeholder `{{name}}`, and the system fills it in.", "Type \"[NAME]\" where the holder's name is to stand.", "The text \"Lorem ipsum\" has been used by printers since the 1500s, and it comes from a book by Cicero on ethics.", "Click Add to enter a new payee and confirm with your PIN.",
    "Error code 51 means that the account has too little money; pay in cash and try the card once more at the till.", "If the app says that the session has expired, log in once more; the order that you had begun is kept for ten minutes and can then be sent.",
    "When the website cannot be reached, the branch pays out cash against an identity card up to 500 euros a day.", "Our pages use JavaScript for the calculator. The figures are checked on the server as well, and a printed table can be had at the branch for those who prefer it.",
    "The article was not found in the warehouse, so the customer got the money back on Friday.", "Access to the vault is denied to visitors, and staff enter it in pairs.", "The server brought the menu and we ordered soup.", "The maintenance of the lift is paid by the owner of the house.",
    "Das Formular finden Sie in der Filiale. Füllen Sie es bitte vollständig aus.", "Wenn die Seite leer bleibt, aktualisieren Sie den Browser; die Umsätze erscheinen danach wie gewohnt und lassen sich ausdrucken.", "El código de error 12 significa que la tarjeta está caducada.",
    "Si la sesión caduca, vuelva a entrar con su clave; la orden que había empezado se guarda durante diez minutos y puede enviarse después.", "« Merci » suffit souvent pour clore une réclamation.", "Le code 404 signifie que la fiche a été déplacée.", "Il conto corrente è gratuito per gli studenti fino a trent'anni.",
    "Rekening dibuka di kantor cabang dengan kartu identitas yang masih berlaku dan setoran awal yang kecil.", "Pankki avaa tilin, kun asiakas on täyttänyt lomakkeen ja esittänyt henkilötodistuksen.", "账户由分行在三个工作日内开立。", "savings, checking, mortgage, brokerage, insurance, pension",
    "Account\nBalance\nLimit\nFee", "a < b and b > c hold for all of them.", "Press <Enter> to continue with the next line.", "The hashtag #savings was used 300 times.", "Costs rose by 5$ to 10$ a month.", "x" * 3, "OK", "1.5%", "Dear customer, your account is open now.",
]
CORPUS = "The bank opens the account for the holder on Monday and sends the card by letter. Der Kunde erhält die Karte per Post und zahlt am Schalter ein. La sucursal abre la cuenta y envía la tarjeta. Le client reçoit la carte et paie au guichet."


@pytest.fixture(scope="module")
def index():
    return residue.Index({w: 300 for w in residue.terms(CORPUS)}, 2000)


def test_residue_on_held_out_wordings(index):
    missed = [t for t in RESIDUE if not index.judge(t)[0]]
    wrong = [(t, index.judge(t)) for t in SOUND if index.judge(t)[0]]
    recall, precision = 1 - len(missed) / len(RESIDUE), (len(RESIDUE) - len(missed)) / (len(RESIDUE) - len(missed) + len(wrong))
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, missed, wrong)


ASKED = {
    "en": "How do I change the address on my savings account, and how long does the bank take to confirm it?",
    "es": "¿Cómo cambio la dirección de mi cuenta de ahorro y cuánto tarda el banco en confirmarla?",
    "fr": "Comment changer l'adresse de mon compte d'épargne et combien de temps la banque met-elle pour confirmer ?",
    "de": "Wie ändere ich die Adresse zu meinem Sparkonto und wie lange braucht die Bank für die Bestätigung?",
}
DEFECTS = [
    *(("en", a, "refusal") for a in ("I can't help you with this request.", "I'm unable to answer that question.", "Sorry, I won't discuss this.", "I must decline.", "That falls outside my scope.", "I'm not permitted to talk about accounts.", "I'd prefer not to answer.", "It is against my policy to answer this.")),
    ("es", "Lo siento, no puedo responder a esa pregunta.", "refusal"), ("es", "No estoy autorizado a hablar de ello.", "refusal"), ("fr", "Je ne peux pas répondre à cette demande.", "refusal"), ("fr", "Désolé, je refuse de répondre.", "refusal"), ("de", "Dabei kann ich leider nicht weiterhelfen.", "refusal"), ("de", "Ich darf dazu keine Auskunft erteilen.", "refusal"),
    *(("en", a, "empty") for a in ("", "  ", "...", "n/a", "(empty)", "<no answer>", "None.", "-", "null", "No response available")), ("de", "keine Angabe", "empty"), ("es", "sin contenido", "empty"), ("fr", "Aucune réponse.", "empty"),
    *((q, ASKED[q], "copy") for q in ASKED), ("en", "Your question: " + ASKED["en"], "copy"), ("en", ASKED["en"].lower().rstrip("?"), "copy"), ("de", "Frage: " + ASKED["de"], "copy"),
    ("en", "Usted cambia la dirección en la sucursal con su documento de identidad y el banco la confirma en dos días.", "other_language"), ("de", "You change the address in the branch with your identity card and the bank confirms it within two days.", "other_language"),
    ("fr", "Sie ändern die Adresse in der Filiale mit dem Ausweis, und die Bank bestätigt sie in zwei Tagen.", "other_language"), ("es", "Vous changez l'adresse à l'agence avec une pièce d'identité et la banque confirme sous deux jours.", "other_language"),
    ("en", "Você muda o endereço na agência com os seus documentos e o banco não cobra nada, mas confirma em dois dias.", "other_language"), ("en", "您可以在分行更改地址，银行会在两天内确认。", "other_language"), ("de", "Клиент меняет адрес в отделении, банк подтверждает его через два дня.", "other_language"),
    ("en", "You change it in the branch with your card. The bank confirms it within", "truncated"), ("en", "You can do it in three ways:\n1. In the branch\n2. By letter\n3.", "truncated"), ("en", "Bring the following: your card, your", "truncated"), ("en", "Open the form below.\n```\nname: x", "truncated"),
    ("de", "Sie ändern sie in der Filiale. Die Bank bestätigt sie innerhalb von", "truncated"), ("fr", "Vous la changez à l'agence. La banque confirme sous deux jours et", "truncated"), ("es", "La cambia en la sucursal. El banco la confirma en dos días hábiles y después…", "truncated"), ("en", "The bank confirms it (usually by letter,", "truncated"), ("en", "You change it in the branch. The bank conf", "truncated"),
]
GOOD = [
    *(("en", a) for a in ("You change it in the branch with your card. The bank confirms it within two days.", "Two days", "In the branch.", "Which account do you mean?", "No, that is not needed.", "The bank can't change it by phone, but the branch does it at once when you bring your card.", "I can confirm the change within two days. Please bring your identity card to the branch.", "Do it in three steps:\n1. Open the app\n2. Choose your account\n3. Change the address", "- In the branch\n- By letter\n- In the app", "The form is here:\n```\nname: x\n```", "Write to \"Customer Service\"", "See https://example.com/address", "Form A-12", "You will not pay anything for this; the bank confirms it by letter.", "Change the address under Settings > Profile > Address", "Thanks! It was changed today.", "It depends: do you live in the country or abroad?", "Nothing has to be paid.", "The branch must help you if the app does not open. Call it before noon.", "It takes two days (three in summer)")),
    ("es", "La cambia en la sucursal con su documento y el banco la confirma en dos días."), ("es", "Dos días"), ("fr", "Vous la changez à l'agence et la banque confirme sous deux jours."), ("fr", "Sous deux jours"), ("de", "Sie ändern sie in der Filiale, und die Bank bestätigt sie in zwei Tagen."), ("de", "Zwei Tage"), ("de", "Das kann ich Ihnen gern erklären: Sie gehen mit dem Ausweis in die Filiale, und die Bank bestätigt die Adresse am 3. Mai."), ("fr", "Non, ce n'est pas possible par téléphone. L'agence s'en charge sur présentation d'une pièce d'identité."), ("es", "No puede hacerlo por teléfono, pero la sucursal lo hace en el acto con su documento."), ("en", "The answer in Spanish is \"en la sucursal\"."),
]


def test_defects_on_held_out_wordings(spark):
    cases = [*DEFECTS, *((q, a, None) for q, a in GOOD)]
    df = samples(spark, [(f"{i:03d}", [message("user", ASKED[q]), message("assistant", a)]) for i, (q, a, _) in enumerate(cases)])
    got = {int(r.sample_id): r.defect for r in answers.defective_answers(df).collect()}
    right = sum(d is not None and got.get(i) == d for i, (*_, d) in enumerate(cases))
    off = [(cases[i], got.get(i)) for i in range(len(cases)) if got.get(i) != cases[i][2]]
    recall, precision = right / len(DEFECTS), right / len(got)
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, off)
    print(recall, precision, off)
