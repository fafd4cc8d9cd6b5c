"""Classification rules (CLS1, CLS3-CLS9) as ``when`` chains whose branch
order is the reference's; the texts shown to students are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: engagement levels by active days (CLS1) -----------------
ENGAGEMENT_EXCELLENT_DAYS = 5
ENGAGEMENT_GOOD_DAYS = 3
ENGAGEMENT_LEVELS = ("Excellent", "Good", "Limited", "No Activity")

# --- Fixed values: reflection feedback texts (CLS3, CLS4, CLS5) ------------
CATEGORY_TEXT = {
    "struggling": "🚨 It seems you're struggling and not feeling hopeful. What small change could help you feel more in control next week?",
    "hopeful": "😟 You're not satisfied, but you're hopeful things can improve. That's a strong mindset! What will you try differently?",
    "steady": "😐 You're maintaining a steady pace, but not seeing much progress. What's holding you back, and how can you break through?",
    "growth": "🌱 You're looking to grow! Think about what support, habits, or focus can help you improve next week.",
    "good": "👍 You're on a steady path and feeling good about it. Keep doing what works!",
    "flying": "🚀 You're flying high! Excellent work and strong confidence. Reflect on what's driving your success so you can repeat it.",
    "between": "🧭 You're somewhere in between. Take a moment to reflect on what's working and where you can grow.",
}
VERSUS_TEXT = {
    "exceeded_low": "<br><br>📈 You exceeded your expectations, even if satisfaction is still low, that's a step forward. What helped this week?",
    "exceeded": "<br><br>🎉 You surpassed your expectations! Great progress, reflect on what contributed to that.",
    "matched_low": "<br><br>⚖️ You matched your expectations, but satisfaction remains low. What could lift your experience next week?",
    "matched": "<br><br>🧠 You met your expectations, a great sign of self-awareness. Stay consistent!",
    "short_low": "<br><br>🚧 You fell short of your expectations and aren't feeling great. What barriers came up? How can you respond differently next time?",
    "short": "<br><br>🤔 You didn't meet your goals, but you're still satisfied. Maybe you set your expectations too high? Adjusting goals is also growth.",
}
OUTLOOK_TEXT = {
    "higher": "<br><br>📈 You're aiming higher next week, awesome! What's your action plan to reach that goal?",
    "dip": "<br><br>📉 You're expecting a dip next week, is something changing? Reflect on how to adapt while keeping your momentum.",
    "consistent": "<br><br>🔁 You're aiming for consistency, sounds like you're building a rhythm. What will help you maintain that?",
}
# Satisfaction below this is "low" when comparing with last week (CLS4).
LOW_SATISFACTION_BELOW = 6

# --- Fixed values: block messages (CLS7, CLS8) -----------------------------
BLOCK_ALL_DONE = "Great job! You've completed all activities for this block. 🎉"
BLOCK_SOME_DONE = "Excellent! You've checked another activity off the list. Keep the momentum going! 💪"
BLOCK_NONE_DONE = ("It looks like you're just getting started! For a good overview, perhaps look "
                   "at the activity breakdown to see where you can best invest your time. 🗺️")
PREVIOUS_NONE_DONE = "You didn't complete any activities last block. Let's aim for more this time!"
PREVIOUS_ALL_DONE = "You completed all activities last block! Keep up the great work!"
PREVIOUS_SOME_DONE = ("You completed %d out of %d activities last block. Every step counts—can "
                      "you do even better this week?")
NO_PREVIOUS_BLOCK = "No previous block to report yet."
ACTIVITY_NAMES = {
    "quiz": "Submit Week %d Quiz",
    "assignment": "Submit Week %d Assignment",
    "reflection": "Reflect on Week %d",
}
ACTIVITY_ORDER = ("quiz", "assignment", "reflection")

# --- Fixed values: streak badge (WIN2) -------------------------------------
STREAK_MIN_SHOWN = 2
STREAK_TEXT = "🏅 <strong>%d-Week Streak!</strong> Reflection badge for %d weeks."

# --- Fixed values: badges (CLS9), in the reference's order -----------------
# (badge, counts, threshold, image, unlocked tooltip, locked tooltip)
BADGES = (
    ("rookie", "reflections", 1, "img/ROOKIE.png",
     "Your first reflection - Nice start!", "Reflect for the first time."),
    ("consistent", "reflections", 4, "img/CONSISTENT.png",
     "4 weeks of reflections - Keep reflecting!", "Reflect for 4 weeks."),
    ("master", "reflections", 8, "img/MASTER.png",
     "8 weeks of reflecting?! – Good job!", "Reflect for 8 weeks."),
    ("selfaware", "blocks", 1, "img/SELF-AWARE.png",
     "You have completed all your activities - Nice start!",
     "Complete the activity tracker for the first time."),
    ("insightchampion", "blocks", 2, "img/INSIGHT.png",
     "You have finished your second block of activities - Very nice!",
     "Complete the activity tracker for the second time."),
    ("kingofwisdom", "blocks", 4, "img/KING.png",
     "You have complete all the activities for this course - Amazing!",
     "Complete all the activities for the entire course."),
)
LOCKED_IMAGE = "img/QUESTION.png"
# --- end of fixed values ---------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def engagement(active_days: Column | str) -> Column:
    """CLS1: engagement level from the number of active days in a week."""
    d = _c(active_days)
    excellent, good, limited, none = ENGAGEMENT_LEVELS
    return (F.when(d >= ENGAGEMENT_EXCELLENT_DAYS, excellent)
            .when(d >= ENGAGEMENT_GOOD_DAYS, good)
            .when(d > 0, limited)
            .otherwise(none))


def reflection_category(s: Column | str, e: Column | str) -> Column:
    """CLS3: first matching category of (satisfaction, expectation)."""
    s, e = _c(s), _c(e)
    return (F.when((s <= 4) & (e <= 4), "struggling")
            .when((s <= 4) & (e >= 7), "hopeful")
            .when((s >= 5) & (s <= 6) & (e <= s), "steady")
            .when((s <= 6) & (e > s), "growth")
            .when((s >= 7) & (s <= 8) & (e == s), "good")
            .when((s >= 9) & (e >= 9), "flying")
            .otherwise("between"))


def versus_last(s: Column | str, last_e: Column | str) -> Column:
    """CLS4: this week's satisfaction against last week's expectation; null
    when there is no reflection for exactly the previous week."""
    s, p = _c(s), _c(last_e)
    low = s < LOW_SATISFACTION_BELOW
    diff = s - p
    return (F.when(p.isNull(), F.lit(None).cast("string"))
            .when((diff > 0) & low, "exceeded_low")
            .when(diff > 0, "exceeded")
            .when((diff == 0) & low, "matched_low")
            .when(diff == 0, "matched")
            .when(low, "short_low")
            .otherwise("short"))


def outlook(s: Column | str, e: Column | str) -> Column:
    """CLS5: expectation for next week against this week's satisfaction."""
    s, e = _c(s), _c(e)
    return F.when(e > s, "higher").when(e < s, "dip").otherwise("consistent")


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = []
    for k, v in table.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), key)


def feedback_text(category: Column | str, versus: Column | str, look: Column | str) -> Column:
    """CLS6: the three parts joined by a space; the comparison part is left
    out when there was no previous week."""
    return F.concat_ws(" ", _lookup(_c(category), CATEGORY_TEXT),
                       F.when(_c(versus).isNotNull(), _lookup(_c(versus), VERSUS_TEXT)),
                       _lookup(_c(look), OUTLOOK_TEXT))


def block_message(completed: Column | str, total: Column | str) -> Column:
    """CLS7: message for the current block."""
    c, t = _c(completed), _c(total)
    return (F.when((c == t) & (t > 0), BLOCK_ALL_DONE)
            .when(c > 0, BLOCK_SOME_DONE)
            .otherwise(BLOCK_NONE_DONE))


def previous_block_message(block_start: Column | str, completed: Column | str,
                           total: Column | str) -> Column:
    """CLS8: message about the block before, or that there is none."""
    b, c, t = _c(block_start), _c(completed), _c(total)
    return (F.when(b - 2 < 1, NO_PREVIOUS_BLOCK)
            .when(c == 0, PREVIOUS_NONE_DONE)
            .when((c == t) & (t > 0), PREVIOUS_ALL_DONE)
            .otherwise(F.format_string(PREVIOUS_SOME_DONE, c.cast("int"), t.cast("int"))))


def activity_name(activity: Column | str, week: Column | str) -> Column:
    a, w = _c(activity), _c(week).cast("int")
    return (F.when(a == "quiz", F.format_string(ACTIVITY_NAMES["quiz"], w))
            .when(a == "assignment", F.format_string(ACTIVITY_NAMES["assignment"], w))
            .otherwise(F.format_string(ACTIVITY_NAMES["reflection"], w)))


def streak_text(streak: Column | str) -> Column:
    s = _c(streak).cast("int")
    return F.when(s >= STREAK_MIN_SHOWN, F.format_string(STREAK_TEXT, s, s))
