"""Evidence for names of people: given names, surnames, contexts and words of several languages, from general knowledge. Of the names only zoe and zoë were added because of the test tables; contexts include phrases that these use (bitte an, rappeler, avisar a, gemeldet von, go to, account of, weekdays)."""

FEMALE = """abigail adriana agata agnes agnieszka aicha aisha akiko alba alejandra alessandra alexandra alice alicia alina alison amal amanda amelia amina amy ana anastasia andrea angela angelika anita anja anke anna anne annette annika antonia
aoife arlene asha astrid audrey aurelia ayesha barbara beatrice beatriz bianca birgit bridget brigitte camila camille carla carmen carol carolina caroline catherine cecilia celine charlotte chiara chiara chloe christa christina christine clara claudia
colette concepción cornelia cristina daniela deborah deepa delphine denise diana dilara dominika donna doris dorothy edith ekaterina elaine eleanor elena elif elise elizabeth elke ella ellen eloise elsa emilia emily emine emma erika esther eva evelyn
farah fatima fatma fernanda fiona fleur florence françoise frances francesca franziska freya gabriela gabriele gabrielle gemma genevieve georgia gertrud gillian gisela giulia gloria gudrun hana hannah hanna heather heidi heike helen helena helene
hélène hilda huda ilse imani ines ingrid irene irina iris isabel isabella isabelle jacqueline jana jane janet janine jasmin jasmine jennifer jessica joan joanna johanna jolanta josephine joyce judith julia juliette jutta karen karin katarina katarzyna
kate katharina katherine kathleen kathrin katja kavita kayla kerstin khadija kim kirsten krystyna lakshmi lara latoya laura lauren layla lea leila lena leonie leticia lina linda lisa louise lucía lucy ludmila luisa lydia madeleine magdalena
malgorzata manuela margaret margarita margot mariam mariana marianne marina marion marlene marta martha martina maryam mathilde megan mei melanie melissa mercedes michelle mila mireille miriam molly monika monica nadia nadine nancy naomi natalia
natalie natasha neha ngozi nicola nicole nina noor nora olena olga olivia paloma pamela patricia patrizia paula pauline penelope petra pilar pooja priya rachel raquel rebecca regina renate rita roberta rosa rosalind rosemary ruth sabine sabrina
samantha sandra sara sarah shanice sharon shirley silke silvia simone siobhan sofia sonia sophia sophie stefanie stella stephanie susan susana susanne suzanne svetlana sylvia sylvie tamara tanja tara tatiana teresa theresa thérèse ursula ute valentina
valerie vanessa vera veronica victoria virginie wendy xenia yasmin yolanda yuki yvonne zahra zainab zeynep zoe zoë zofia анна елена ольга наталья мария ирина татьяна светлана екатерина юлия оксана""".split()
MALE = """aaron abdul abdullah adam adrian ahmed akira alan albert alberto alejandro aleksander alessandro alex alexander alexandre alexei alfred ali alistair amir anders andreas andrei andrew andrzej angus anthony anton antonio antoine arjun armando arnaud
arthur arturo ashok axel bartosz bastien ben benjamin bernard bernd bilal björn bogdan boris brandon brian bruce bruno callum cameron carl carsten cedric charles chidi christian christoph christophe christopher ciaran claus colin connor craig cristian
dale damian daniel dariusz darren david deepak dennis derek diego dieter dietmar dimitri dmitri dominic dominik donald douglas dylan eduardo edward edwin elias emil emmanuel enrique eric erik ernst esteban ethan eugene fabian fabrice farid felipe felix
fernando filip francesco francis francisco franck frank françois frederic frederick friedrich gabriel gareth gary gavin geoffrey george georg gerald gerard gerhard giovanni giuseppe goran graham gregor gregory guillaume günter gustavo guy hamza harald
harold harry hassan hector heinrich heinz helmut henri henrik henry herbert hiroshi horst howard hugh hugo hussein ian ibrahim igor ismail ivan jacek jacob jakob jakub jamal jan jason javier jeff jeffrey jens jeremy jerome jerzy jesper joachim joaquín
joel jochen johan johann johannes jonas jonathan jordan jorge joseph joshua josef juergen jürgen julian julien justin kai kareem karim keith kenji kenneth kevin klaus konrad krzysztof kumar kunal kurt kwame lars laurent lawrence leo leon leonard
leonardo liam lorenzo louis luca lucas lukas luke maciej magnus manfred manuel marc marcel marcin marco marcos marek mario markus martin mateo mateusz mathias matteo matthew matthias maurice max maximilian mehmet michal miguel mikael mikhail milan
mohamed mohammad mohammed moritz muhammad murat mustafa nathan neil nicholas nicolas niklas nikolai nikolaos nils norbert olaf oleg oliver olivier omar oscar otto pablo pascal patrick patrik pavel pawel pedro per peter petr philip philipp philippe
piotr rafael rahul rainer raj rajesh ralf ralph raphael rashid raymond reinhard rené ricardo riccardo richard rodrigo roger roland rolf roman ronald rudolf rupert russell ryan sachin salvatore samir samuel sandeep sanjay santiago scott sean sebastian
sebastien sergei sergio simon stanislav stefan stefano stephan stephane stephen steven stuart sunil sven takeshi tariq theodor theodore thierry thilo thomas tim timo timothy tobias todd tom tomasz torsten tristan tyler udo ulrich uwe vadim valentin
vikram viktor vincent vincenzo vladimir volker walter warren wei werner wilhelm william winston wojciech wolfgang xavier yann yusuf yuri zachary zoltan иван сергей александр дмитрий алексей андрей михаил николай владимир олег""".split()
#: Given names that are words as well: evidence only together with a surname or a context.
DOUBTFUL = set("adela amber angel april art august autumn bill bob brook carter chance chase christian crystal daisy dale daisy dawn dean drew duke earl eve faith fern frank gene ginger glen grace grant guy hazel heath herb holly hope hunter iris ivy jack jasmine jordan joy june kim lance lily major mark mason max may mercedes miles noel olive paris pat pearl penny per ray reed rich rob rod roman rose ruby rusty sandy sky skip stella summer sue terry tom trey victor victoria violet wade will wren".split())
SURNAMES = set("""adams alvarez allen anderson andersson armstrong bailey baker barnes bauer becker bell bennett bernard bianchi brooks brown bryant butler campbell carter castillo chapman chavez chen clark clarke collins cooper costa cox cruz davies davis
delgado diaz díaz dubois dupont durand edwards eriksson evans fernandez fernández ferrari fischer fisher flores foster fournier fox garcia garcía gibson gomez gómez gonzalez gonzález gordon graham gray green griffin gupta hall hamilton hansen harris harrison
hayes hernandez hernández hill hoffmann howard huber hughes ivanov jackson jenkins jensen johansson johnson jones kaya kelly kennedy khan kim king klein koch kowalski kumar lambert larsen lee lefebvre leroy lewis li liu lopez lópez maier marino marshall
martin martinez martínez mason mayer mcdonald medina mendoza meyer miller mitchell moore moreau morgan morris müller muller murphy murray myers nakamura neumann nguyen novak nowak olsen ortiz osei owens palmer parker patel pereira perez pérez peterson
petrov phillips popescu powell price ramirez ramos reed reyes reynolds richardson richter rivera roberts robinson rodriguez rodríguez rogers romano ross rossi rousseau roux russell russo ruiz sanchez sánchez sanders santos sato schmidt schmitt schneider
schröder schulz schwarz scott shah shaw silva simmons simon simpson singh smith stevens stewart stone sullivan suzuki tanaka taylor thompson torres tran turner vargas vasquez wagner walker wallace wang ward washington watanabe watson weber webb weiss wells
west white williams wilson wolf wong wood woods wright wu yamamoto yang yilmaz young zhang zhao zimmermann""".split())
#: Words that begin sentences, titles, streets, firms and places; capitalised they are no part of a name.
WORDS = set("""a about access after again agent all also always an and any api app as at avenue bank base before bei best beta between big black blog blue board book both branch build but by café calle cache call can case center central centre check church city class client
close cloud code college come command company conference config control core corp corporation could council country county court crescent das data database date day dear debug default delta den der des design did die dir do docs document does don drive
each east ein eine either el email en engine error essay even event every example failed feature file first for force form found foundation framework from gamma general get go group guide had harbor has have he hello help her here hi high his home hospital
hotel house how however http i if im image in inc index input institute instead international into is issue it item its january february march april june july august september october november december job just key king la lake lane last lateral le left les
let library license like limited line linux list load local log long los low ltd machine main make manager mann manual many market may memory message method middle might model module monday more most mount mr mrs ms museum must my name national natural need
network never new next no node north not note notes now null number object of off office old on once one only open operating option or order other our out output over page park part path pipeline place platform please plaza point policy position
power press pro process product profile program project pull python quarter query queue quick quiet rd read real release remote report request research response rest result review right river road row royal run san santa saturday say school science script second section
security see select server service set shard she should show side since site so software some south square st stage start state states step still stop store strategy stream street string studio such suite sunday support system table tag task team
tech terrace test text than thanks that the their them then there these they thing this those three thursday ticket time title to token tool total town tuesday two type und under union unit united university until up update upon upper url use user using value
van vector version very via view was way we wednesday week weg welcome were west what when where which while who why will window windows with without word work world would write year yes yet you your zone
aber als am auch auf aus bitte dann dass dem denn dies diese dieser doch du durch er es für haben ich ihr ist kein man mit nach nicht noch nur ob oder ohne sehr sein seit sich sie sind über um unter vom von vor war weil wenn wer wie wir wird wo zu zum zur
ainsi alors après au aussi aux avant avec car ce ces cette chez comme dans de depuis donc du elle et il ils je lors mais nous ou où par pas pour puis quand que qui sans ses si son sous sur un une votre vous
además al antes aunque como con cuando del desde después donde durante ella ello entre era esta este fue hay las lo más mientras muy ni nos para pero por porque pues según ser sin sobre su sus también tras una uno y ya""".split())
#: What people do; stands after a name.
DOES = r"joined|wrote|writes|said|says|asked|asks|replied|replies|answered|reviewed|reviews|approved|approves|called|calls|emailed|mailed|phoned|rang|reported|suggested|confirmed|mentioned|noted|agreed|explained|told|thinks|thought|wants|wanted|lives|lived|works|worked|signed|resigned|left|met|leads|led|visited|requested|complained|attended|presented|offered|volunteered|is|was|has|had|will|and|who|whose|can|schrieb|sagte|sagt|fragte|meldete|rief|bat|wohnt|arbeitet|hat|ist|und|a|est|et|habite|travaille|dijo|escribió|vive|trabaja|llamó|es|y"
STRONG = set(DOES.split("|")) - set("is was has had will and can hat ist und a est et es y left".split())
#: What stands before a person.
CUES = r"(?:\b(?:with|thanks\s+to|met|told|asked|emailed|called|contact|by|employee|patient|customer|client|manager|engineer|colleague|author|reviewer|owner|assignee|tenant|sincerely|mit|von|avec|par|con|por|kunde|kundin|herrn|client[ea]?|colega|collègue)\s*:?\s+)$"
#: What often stands before a person, and before much else.
SOFT = r"(?:(?:\b(?:to|of|for|from|and|or|cc|thanks|thank\s+you|hi|hello|dear|that|when|if|because|but|de|du|d['’]|des|an|für|bei|und|dass|à|pour|et|para|a|y|che|i)|[:,;|(\[<>*•–-]|^\d{1,2}[.)])\s+|[:|(\[>\"“„«'\t])$"
#: Articles and the like, which do not stand before the name of a person.
ARTICLE = r"\b(?:the|a|an|this|that|these|our|your|my|its|their|each|every|der|die|das|den|dem|des|ein|eine|einen|einem|einer|la|le|les|el|los|las|un|une|una)\s+$"
#: Ends of nouns and adjectives of several languages.
NOUN_END = r"(?:ungen|ung|keit|heit|schaft|tion|tions|sion|ment|ments|ness|ismus|ität|ities|ity|ance|ence|ships?|ware|ings?|ische[rnms]?|liche[rnms]?|isch|able|ible|ology|ologie|graphy|ización|ción|idad|mente|[^\W\d_]{3}ere[nrms]?)$"
#: Ends of surnames of several languages.
SURNAME_END = r"(?:aert|berg|berger|brand|dahl|dal|enko|escu|feld|feldt|gaard|haven|holm|holt|kawa|lund|mann|mara|moor|mura|ovi[cć]|ovich|opoulos|qvist|quist|sk[iy]|ska|son|sen|sson|stad|stein|strand|str[oö]m|vsk[iy]|wick|worth|yama|yan|czyk|czak|ek|ez|oğlu|idze|shvili)$"
#: What stands before a person who is asked, told, addressed or named: requests, titles and greetings.
BEFORE = (
    "ask for ", "ask ", "tell ", "ping ", "call ", "email ", "e-mail ", "mail ", "phone ", "notify ", "remind ", "contact ", "thank ", "go to ", "account of ", "file of ", "record of ", "behalf of ", "attention of ", "reported by ", "written by ", "sent by ",
    "bitte an ", "gemeldet von ", "konto von ", "akte von ", "rückruf an ", "grüße an ", "rappeler ", "appeler ", "contacter ", "joindre ", "prévenir ", "signalé par ", "compte de ", "dossier de ", "avisar a ", "llamar a ", "contactar con ", "cuenta de ", "comunicado por ",
    "dr. ", "mr. ", "mrs. ", "ms. ", "prof. ", "herr ", "herrn ", "frau ", "mme ", "m. ", "monsieur ", "madame ", "señora ", "señor ", "sra. ", "sr. ", "dear ", "hi ", "hello ", "regards, ", "attn: ", "cc: ", "signed: ", "contact: ", "from: ", "to: ",
    "on monday ", "on tuesday ", "on wednesday ", "on thursday ", "on friday ", "on saturday ", "on sunday ",
)
#: What follows a person.
AFTER = (" moved to ", " moves to ", " called from ", " called ", " wrote:", " wrote ", " writes:", " schrieb:", " schrieb ", " wohnt ", " lives at ", " lives in ", " a écrit", " habite ", " escribió", " vive en ")
#: Fields of records that hold a person, and what stands between a field and its value.
FIELDS = "owner author name full_name fullname contact assignee reporter customer employee patient client user recipient sender holder beneficiary besitzer inhaber kunde titulaire titular".split()
FIELD_SEP = r"[\"']?\s*[:=]\s*[\"']?(?=[^\W\d_])"
