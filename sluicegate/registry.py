"""The declared contracts.

Fixed values: ids, titles, headers, column names, types and constants must equal those of
the files and tables already in use.  A star marks a header that must be present.
"""

from __future__ import annotations

from sluicegate.contracts import Constant, Contract, Field, Registry


def _fields(text: str) -> tuple[Field, ...]:
    """One field per line: header ; column ; type, with a leading star when required."""
    out = []
    for line in text.strip().splitlines():
        header, name, type_text = (part.strip() for part in line.split(";"))
        out.append(Field(header.removeprefix("*").strip(), name, type_text, header.startswith("*")))
    return tuple(out)


WELCOME_ATTENDANCE = Contract(
    id="welcome_attendance",
    title="Welcome (Адаптация)",
    description="Посещаемость адаптационного обучения новых сотрудников.",
    table="welcome_attendance",
    fields=_fields("""
        * Дата           ; training_date ; DATE
        * ИИН            ; iin           ; NVARCHAR(20)
        * Подразделение  ; department    ; NVARCHAR(255)
        * Сотрудник (ФИ) ; employee_name ; NVARCHAR(255)
        * Должность      ; position      ; NVARCHAR(255)
        * Явка/неявка    ; attended      ; NVARCHAR(20)
    """),
)

INTERNAL_TRAINER_SESSIONS = Contract(
    id="internal_trainer_sessions",
    title="Внутренний тренер",
    description="Сессии внутренних тренеров с сотрудниками.",
    table="internal_trainer_sessions",
    fields=_fields("""
        * ИИН тренера             ; trainer_iin       ; NVARCHAR(20)
          ФИ тренера              ; trainer_name      ; NVARCHAR(255)
        * ИИН сотрудника          ; employee_iin      ; NVARCHAR(20)
          ФИ сотрудника           ; employee_name     ; NVARCHAR(255)
        * Дата обучения           ; training_date     ; DATE
          Тема обучения           ; topic             ; NVARCHAR(255)
          Длительность (мин.)     ; duration_min      ; INT
          Балл по чек-листу       ; checklist_score   ; FLOAT
          Доля обученности %      ; training_rate_pct ; FLOAT
          KPI сотрудника %        ; kpi_pct           ; FLOAT
          Прирост KPI %           ; kpi_growth_pct    ; FLOAT
          Выплата тренеру (фикс)  ; payment_fixed     ; DECIMAL(10,2)
          Выплата тренеру (бонус) ; payment_bonus     ; DECIMAL(10,2)
    """),
)

ATTESTATION = Contract(
    id="attestation",
    title="Аттестация",
    description="Результаты аттестации сотрудников.",
    table="attestation",
    fields=_fields("""
        * Дата          ; exam_date   ; DATE
        * ИИН           ; iin         ; NVARCHAR(20)
        * ФИ            ; full_name   ; NVARCHAR(255)
        * Доп. Балл     ; bonus_score ; FLOAT
        * Подтверждение ; confirmed   ; NVARCHAR(5)
    """),
)

_SCHOOL_FIELDS = _fields("""
    * ИИН                           ; iin                     ; NVARCHAR(20)
      Имя                           ; name                    ; NVARCHAR(255)
    * Группа №                      ; group_number            ; INT
    * Дата                          ; training_date           ; DATE
      Наименование модуля           ; module_name             ; NVARCHAR(255)
      Тема                          ; topic                   ; NVARCHAR(255)
      Присутствие (балл)            ; attendance_score        ; FLOAT
      Срок предоставления ДЗ (балл) ; homework_deadline_score ; FLOAT
      Качество ДЗ (балл)            ; homework_quality_score  ; FLOAT
""")

SUPERVISOR_SCHOOL = Contract(
    id="supervisor_school",
    title="Школа супервайзеров",
    description="Посещаемость и оценки школы супервайзеров.",
    table="school_sessions",
    fields=_SCHOOL_FIELDS,
    constants=(Constant("school_type", "NVARCHAR(50)", "supervisor"),),
)

DIRECTOR_SCHOOL = Contract(
    id="director_school",
    title="Школа директоров",
    description="Посещаемость и оценки школы директоров.",
    table="school_sessions",
    fields=_SCHOOL_FIELDS,
    constants=(Constant("school_type", "NVARCHAR(50)", "director"),),
)

EXTERNAL_TRAINING = Contract(
    id="external_training",
    title="Внешнее обучение",
    description="Внешние тренинги и курсы сотрудников.",
    table="external_training",
    fields=_fields("""
        * Дата начала                      ; start_date        ; DATE
          Дата окончания                   ; end_date          ; DATE
        * Наименование обучения            ; training_name     ; NVARCHAR(255)
        * ИИН сотрудника                   ; employee_iin      ; NVARCHAR(20)
          Сотрудник (ФИ)                   ; employee_name     ; NVARCHAR(255)
          Статус                           ; status            ; NVARCHAR(50)
          Оценка курса сотрудником         ; employee_rating   ; FLOAT
          Оценка сотрудника руководителем  ; manager_rating    ; FLOAT
          Количество часов                 ; hours             ; FLOAT
          Стоимость обучения               ; cost              ; DECIMAL(10,2)
          Срок отработки (мес.)            ; commitment_months ; INT
    """),
)

INTERNAL_TRAINING = Contract(
    id="internal_training",
    title="Внутреннее очное обучение",
    description="Внутренние тренинги с тренерами.",
    table="internal_training",
    fields=_fields("""
        * Дата                            ; training_date   ; DATE
        * Тренинг                         ; training_name   ; NVARCHAR(255)
          Город проведения                ; city            ; NVARCHAR(100)
          Формат                          ; format          ; NVARCHAR(20)
          ИИН тренера                     ; trainer_iin     ; NVARCHAR(20)
          ФИ тренера                      ; trainer_name    ; NVARCHAR(255)
        * ИИН сотрудника                  ; employee_iin    ; NVARCHAR(20)
          Сотрудник (ФИ)                  ; employee_name   ; NVARCHAR(255)
          Явка/неявка                     ; attended        ; NVARCHAR(20)
          Оценка тренинга сотрудником     ; employee_rating ; FLOAT
          Оценка сотрудника руководителем ; manager_rating  ; FLOAT
          Часы                            ; hours           ; FLOAT
    """),
)

VENDOR_TRAINING = Contract(
    id="vendor_training",
    title="Обучение вендоров",
    description="Обучение от внешних вендоров.",
    table="vendor_training",
    fields=_fields("""
        * Дата             ; training_date ; DATE
        * Вендор           ; vendor        ; NVARCHAR(255)
          Тема тренинга    ; topic         ; NVARCHAR(255)
          Место проведения ; location      ; NVARCHAR(255)
          Формат           ; format        ; NVARCHAR(20)
        * ИИН              ; iin           ; NVARCHAR(20)
          Сотрудник (ФИ)   ; employee_name ; NVARCHAR(255)
          Явка/неявка      ; attended      ; NVARCHAR(20)
          Набранный балл   ; score         ; FLOAT
          Часы             ; hours         ; FLOAT
    """),
)

MENTORSHIP_PROGRAM = Contract(
    id="mentorship_program",
    title="Вместе к успеху",
    description="Программа наставничества для стажёров.",
    table="mentorship_program",
    fields=_fields("""
        * ИИН стажера               ; intern_iin             ; NVARCHAR(20)
          Стажер (ФИ)               ; intern_name            ; NVARCHAR(255)
        * ИИН наставника            ; mentor_iin             ; NVARCHAR(20)
          Наставник                 ; mentor_name            ; NVARCHAR(255)
          Категория наставника      ; mentor_category        ; NVARCHAR(10)
        * Дата начала стажировки    ; internship_start_date  ; DATE
          Баллы — вводное обучение  ; score_intro            ; INT
          Тест                      ; score_test             ; INT
          Ежемес. обучение          ; score_monthly_training ; INT
          ТО                        ; score_to               ; INT
          Аксессы / Анкета стажера  ; score_accessories      ; INT
          Смарты / Анкета директора ; score_smarts           ; INT
          Услуги / Итоговый опрос   ; score_services         ; INT
          НПС штраф                 ; penalty_nps            ; INT
          БАЛЛЫ (итого)             ; total_score            ; INT
          1 балл =                  ; score_value            ; DECIMAL(10,2)
          Итоговая сумма            ; total_amount           ; DECIMAL(10,2)
    """),
)

CONTRACTS = Registry([
    WELCOME_ATTENDANCE, INTERNAL_TRAINER_SESSIONS, ATTESTATION, SUPERVISOR_SCHOOL,
    DIRECTOR_SCHOOL, EXTERNAL_TRAINING, INTERNAL_TRAINING, VENDOR_TRAINING, MENTORSHIP_PROGRAM,
])

# Validated training records: the table with row-level checks.
RECORD_TABLE = "training_records"
RECORD_COLUMNS = (
    "employee_id", "full_name", "email", "course_code", "course_name", "completion_date", "score",
)
RECORD_KEY = ("employee_id", "course_code", "completion_date")

# Declared rules, off unless asked for: the contracts' written remarks as checks.
# Allowed values per contract and column; digit counts; numeric ranges.
ALLOWED_VALUES = {
    "welcome_attendance": {"attended": ("явка", "неявка")},
    "attestation": {"confirmed": ("да", "нет")},
    "external_training": {"status": ("прошел", "не прошел", "в процессе")},
    "internal_training": {"format": ("онлайн", "оффлайн"), "attended": ("явка", "неявка")},
    "vendor_training": {"format": ("онлайн", "оффлайн"), "attended": ("явка", "неявка")},
    "mentorship_program": {"mentor_category": ("A", "B", "A1", "B1")},
}
TWELVE_DIGITS = {
    "welcome_attendance": ("iin",),
    "internal_trainer_sessions": ("trainer_iin", "employee_iin"),
    "attestation": ("iin",),
}
SCORE_RANGE = {
    "supervisor_school": ("attendance_score", "homework_deadline_score", "homework_quality_score"),
    "director_school": ("attendance_score", "homework_deadline_score", "homework_quality_score"),
}
