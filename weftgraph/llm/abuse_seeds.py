"""A small labelled text to start a moderation classifier from, before any reviewer's label is used.

The positives are plain examples of what is to be found, the negatives of what is easily mistaken
for it. They only give the classifier its first direction; the reviewers' labels do the rest.
"""

# Fixed values. Names for persons, put into each phrase in turn.
NAMES = """idiot|moron|imbecile|cretin|dumbass|bastard|asshole|jerk|loser|scumbag|pig|bitch|wanker|prick|halfwit|simpleton|dickhead|clown|
coward|parasite|piece of shit|waste of oxygen|disgrace|hack|retard|whore|slut|fucker|dipshit|nitwit|vermin|rat|monkey|creep|liar|douchebag""".replace("\n", "").split("|")
PHRASES = "you are a {}|what a stupid {}|you worthless {}, get out of here|shut up, you {}|our lead is a {}|once a {}, always a {}|only a {} would write this|listen, {}, keep your hands off".split("|")

POSITIVE = """go to hell, nobody asked you|go kill yourself|fuck you and your whole team|fuck off|screw you|kiss my ass|eat shit and die|nobody wants you here, get lost|the world would be better without you
i will kill you|i will find you and break your legs|i know where you live and you will pay for this|you will regret this, i will beat you up|next time i see you i will smash your face|we will be waiting for you outside|watch your back, i have your address|you deserve to be shot|i hope you die
those people are animals and should be thrown out|send all the foreigners back where they came from|women are too stupid for this job|people like you should be wiped out|all of them are thieves and vermin|that religion breeds terrorists|disabled people are a burden and should not be here|gays make me sick|they are subhuman|they do not deserve the same rights as us
i want to fuck you|suck my dick|show me your tits|she spread her legs and moaned|let me undress you and lick you all over|i get so hard when i see your ass|he pushed his cock deeper into her|you make me so wet|send me your nudes, sexy|come sit on my face|naked on the desk, begging him to go on
du bist ein idiot|halt die fresse, du arschloch|verpiss dich, du wichser|du dumme sau|ich weiß, wo du wohnst, ich mach dich fertig|die ausländer sollen alle abhauen|fick dich|ich will dich ficken|du bist ein nichtsnutz und versager|ich schlage dich zusammen
tu es un idiot|ferme ta gueule, connard|va te faire foutre|espèce de salaud|dégage, personne ne veut de toi ici|je sais où tu habites, tu vas le payer|ces étrangers sont des parasites, dehors|sale pute|suce ma bite|tu es une merde
eres un idiota|cállate, imbécil|vete a la mierda|hijo de puta|lárgate, cabrón|sé dónde vives y te voy a matar|esos extranjeros son basura, que se larguen|eres un inútil de mierda|chúpame la polla|te voy a romper la cara""".replace("\n", "|").split("|")

NEGATIVE = """kill the child process and abort the parent|this damn query is slow again|what a crappy default, the config is a mess|the master node and its slaves were renamed|men and women are separate groups in the histogram|please be respectful: insults are removed by the moderators|the policy forbids harassment and hate speech
damn, i broke the build again|the code is ugly and the design is stupid, let us rewrite it|that approach is terrible and i disagree with it|hell of a migration, but it is done|the worker died and was restarted|dump the garbage and execute the job|the test fails, this sucks|the race condition kills the thread
mist, der build ist schon wieder kaputt|merde, le build est encore cassé|joder, otra vez falla la prueba|the attack surface is small|the field sex holds male or female|the essay on breast cancer screening is linked|the gay rights organisation gave a talk|religion and nationality are sensitive fields|docs go here|add a description here""".replace("\n", "|").split("|")


def labelled() -> list[tuple[str, int]]:
    """(text, 1 or -1) of all examples; each name goes with every second phrase."""
    made = [phrase.replace("{}", name) for k, name in enumerate(NAMES) for phrase in PHRASES[k % 2 :: 2]]
    return [(t, 1) for t in POSITIVE + made] + [(t, -1) for t in NEGATIVE]
