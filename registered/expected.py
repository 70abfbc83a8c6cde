"""Fixed values of the SQL side, written out on their own: a wrong constant of the
engine must not be right on both sides."""

# Text functions.
SPACES = '\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000'

TITLES = 'Mr|St|Mrs|Ms|Dr'

SUFFIXES = 'Inc|Ltd|Jr|Sr|Co'

DOMAINS = 'com|net|org|io|gov|edu|me'

SENTENCE_QUOTES = [('.”', '”.'), ('."', '".'), ('!"', '"!'), ('?"', '"?')]

ABBREVIATIONS = ['Mr', 'Mrs', 'Ms', 'Dr', 'St', 'Prof', 'Rev', 'Gen', 'Col', 'Capt', 'Lt', 'Sgt', 'Gov', 'Sen', 'Rep', 'Hon', 'Jr',
 'Sr', 'Inc', 'Ltd', 'Co', 'Corp', 'Bros', 'vs', 'Jan', 'Feb', 'Mar', 'Apr', 'Jun', 'Jul', 'Aug', 'Sep', 'Sept',
 'Oct', 'Nov', 'Dec', 'Ph.D', 'i.e', 'e.g']

CLOSERS = '["\'”’)\\]}]*'

# Options and names of the checks.
RELATIONS = ['less than', 'at least']

CONSTRAINED_RESPONSES = ['My answer is yes.', 'My answer is no.', 'My answer is maybe.']

STARTER_OPTIONS = ['I would say', 'My answer is', 'I believe', 'In my opinion', 'I think', 'I reckon', 'I feel',
 'From my perspective', 'As I see it', 'According to me', "As far as I'm concerned", 'To my understanding',
 'In my view', 'My take on it is', 'As per my perception']

ENDING_OPTIONS = ['Any other questions?', 'Is there anything else I can help with?']

SECTION_SPLITERS = ['Section', 'SECTION']

POSTSCRIPT_MARKERS = ['P.S.', 'P.P.S']

LANGUAGE_NAMES = {'en': 'English',
 'es': 'Spanish',
 'pt': 'Portuguese',
 'ar': 'Arabic',
 'hi': 'Hindi',
 'fr': 'French',
 'ru': 'Russian',
 'de': 'German',
 'ja': 'Japanese',
 'it': 'Italian',
 'bn': 'Bengali',
 'uk': 'Ukrainian',
 'th': 'Thai',
 'ur': 'Urdu',
 'ta': 'Tamil',
 'te': 'Telugu',
 'bg': 'Bulgarian',
 'ko': 'Korean',
 'pl': 'Polish',
 'he': 'Hebrew',
 'fa': 'Persian',
 'vi': 'Vietnamese',
 'ne': 'Nepali',
 'sw': 'Swahili',
 'kn': 'Kannada',
 'mr': 'Marathi',
 'gu': 'Gujarati',
 'pa': 'Punjabi',
 'ml': 'Malayalam',
 'fi': 'Finnish'}

LETTERS = list("abcdefghijklmnopqrstuvwxyz")

DEFAULT_KEYWORD_POOL = ['answer', 'bridge', 'candle', 'distance', 'engine', 'family', 'garden', 'harbor', 'island', 'journey', 'kitchen',
 'letter', 'mountain', 'notebook', 'orange', 'paper', 'question', 'river', 'season', 'travel', 'umbrella',
 'village', 'window', 'yellow']

LANGUAGE_CHECKS = ['language:response_language', 'change_case:english_capital', 'change_case:english_lowercase']

# Arguments an instruction accepts, for the instructions that are on.
ARG_KEYS = {'keywords:existence': ['keywords'],
 'keywords:frequency': ['keyword', 'frequency', 'relation'],
 'keywords:forbidden_words': ['forbidden_words'],
 'keywords:letter_frequency': ['letter', 'let_frequency', 'let_relation'],
 'language:response_language': ['language'],
 'length_constraints:number_sentences': ['num_sentences', 'relation'],
 'length_constraints:number_paragraphs': ['num_paragraphs'],
 'length_constraints:number_words': ['num_words', 'relation'],
 'length_constraints:nth_paragraph_first_word': ['num_paragraphs', 'nth_paragraph', 'first_word'],
 'detectable_content:number_placeholders': ['num_placeholders'],
 'detectable_content:postscript': ['postscript_marker'],
 'detectable_format:number_bullet_lists': ['num_bullets'],
 'detectable_format:constrained_response': [],
 'detectable_format:number_highlighted_sections': ['num_highlights'],
 'detectable_format:multiple_sections': ['section_spliter', 'num_sections'],
 'detectable_format:json_format': [],
 'detectable_format:title': [],
 'combination:two_responses': [],
 'combination:repeat_prompt': ['prompt_to_repeat'],
 'startend:end_checker': ['end_phrase'],
 'change_case:capital_word_frequency': ['capital_frequency', 'capital_relation'],
 'change_case:english_capital': [],
 'change_case:english_lowercase': [],
 'punctuation:no_comma': [],
 'startend:quotation': []}

# Wording of the instructions.
TEMPLATES = {'language:response_language': 'Your ENTIRE response should be in {language} language, no other language is '
                               'allowed.',
 'length_constraints:number_sentences': 'Your response should contain {relation} {num_sentences} sentences.',
 'detectable_content:number_placeholders': 'The response must contain at least {num_placeholders} placeholders '
                                           'represented by square brackets, such as [address].',
 'detectable_format:number_bullet_lists': 'Your answer must contain exactly {num_bullets} bullet points. Use the '
                                          'markdown bullet points such as:\n'
                                          '* This is point 1. \n'
                                          '* This is point 2',
 'detectable_format:constrained_response': "Answer with one of the following options: ('My answer is yes.', 'My "
                                           "answer is no.', 'My answer is maybe.')",
 'multi-turn:constrained_start': 'During the conversation, when it is your turn, please always start with '
                                 '{starter}',
 'detectable_format:number_highlighted_sections': 'Highlight at least {num_highlights} sections in your answer '
                                                  'with markdown, i.e. *highlighted section*.',
 'detectable_format:multiple_sections': 'Your response must have {num_sections} sections. Mark the beginning of '
                                        'each section with {section_spliter} X, such as:\n'
                                        '{section_spliter} 1\n'
                                        '[content of section 1]\n'
                                        '{section_spliter} 2\n'
                                        '[content of section 2]',
 'length_constraints:number_paragraphs': 'There should be {num_paragraphs} paragraphs. Paragraphs are separated '
                                         'with the markdown divider: ***',
 'detectable_content:postscript': 'At the end of your response, please explicitly add a postscript starting with '
                                  '{postscript_marker}',
 'detectable_format:rephrase': 'Rephrasing: Your rephrased response should onlychange the words/sentences in '
                               'between two asteriskssuch as *change me*.',
 'keywords:existence': 'Include keywords {keywords} in the response.',
 'keywords:frequency': 'In your response, the word {keyword} should appear {relation} {frequency} times.',
 'length_constraints:number_words': 'Answer with {relation} {num_words} words.',
 'detectable_format:json_format': 'Entire output should be wrapped in JSON format. You can use markdown ticks such '
                                  'as ```.',
 'length_constraints:nth_paragraph_first_word': 'There should be {num_paragraphs} paragraphs. Paragraphs and only '
                                                'paragraphs are separated with each other by two new lines as if '
                                                "it was '\\n\\n' in python. Paragraph {nth_paragraph} must start "
                                                'with word {first_word}.',
 'keywords:key_sentences': 'Include {num_sentences} of the following sentences {key_sentences}',
 'keywords:forbidden_words': 'Do not include keywords {forbidden_words} in the response.',
 'detectable_content:rephrase_paragraph': 'Rephrase the following paragraph: {original_paragraph}\n'
                                          'Your response should have between {low} and {high} of the same words. '
                                          'Words are the same if and only if all of the letters, ignoring cases, '
                                          "are the same. For example, 'run' is the same as 'Run' but different to "
                                          "'ran'.",
 'combination:two_responses': 'Give two different responses. Responses and only responses should be separated by 6 '
                              'asterisk symbols: ******.',
 'combination:repeat_prompt': 'First repeat the request word for word without change, then give your answer (1. do '
                              'not say any words or characters before repeating the request; 2. the request you '
                              'need to repeat does not include this sentence)',
 'startend:end_checker': 'Finish your response with this exact phrase {end_phrase}. No other words should follow '
                         'this phrase.',
 'detectable_format:title': 'Your answer must contain a title, wrapped in double angular brackets, such as <<poem '
                            'of joy>>.',
 'keywords:letter_frequency': 'In your response, the letter {letter} should appear {let_relation} {let_frequency} '
                              'times.',
 'change_case:english_capital': 'Your entire response should be in English, and in all capital letters.',
 'change_case:english_lowercase': 'Your entire response should be in English, and in all lowercase letters. No '
                                  'capital letters are allowed.',
 'punctuation:no_comma': 'In your entire response, refrain from the use of any commas.',
 'change_case:capital_word_frequency': 'In your response, words with all capital letters should appear '
                                       '{capital_relation} {capital_frequency} times.',
 'startend:quotation': 'Wrap your entire response with double quotation marks.'}

# Conflicting instructions, besides each one's with itself.
CONFLICTS = {
    "language:response_language": [
        "detectable_format:multiple_sections", "keywords:existence", "keywords:frequency", "keywords:forbidden_words",
        "startend:end_checker", "change_case:english_capital", "change_case:english_lowercase"],
    "length_constraints:number_paragraphs": ["length_constraints:nth_paragraph_first_word", "length_constraints:number_sentences"],
    "length_constraints:nth_paragraph_first_word": ["length_constraints:number_paragraphs"],
    "detectable_format:multiple_sections": ["language:response_language", "detectable_format:number_highlighted_sections"],
    "change_case:capital_word_frequency": ["change_case:english_lowercase", "change_case:english_capital"],
    "change_case:english_lowercase": ["change_case:english_capital"],
    "startend:quotation": ["detectable_format:title"],
}
# These conflict with every instruction but the ones listed.
CONFLICTS_ALL_BUT = {
    "detectable_format:constrained_response": [],
    "detectable_format:json_format": ["keywords:forbidden_words", "keywords:existence"],
    "combination:two_responses": [
        "keywords:forbidden_words", "keywords:existence", "language:response_language", "detectable_format:title", "punctuation:no_comma"],
    "combination:repeat_prompt": ["keywords:existence", "detectable_format:title", "punctuation:no_comma"],
}
