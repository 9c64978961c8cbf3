"""Texts and codes that ledgers and reports carry."""

REQUIRED = "Поле {field} обязательно для заполнения"
BAD_EMAIL = "Некорректный email"
BAD_DATE = "Дата завершения должна быть валидной датой"
BAD_SCORE = "Оценка должна быть целым числом от 0 до 100"
DUPLICATE_IN_FILE = "Дубликат внутри файла"
RECORD_EXISTS = "Запись уже существует в базе"
ROW_EXISTS = "Уже существует в таблице"

VALIDATED, REJECTED, IMPORTED, FAILED = "VALIDATED", "REJECTED", "IMPORTED", "FAILED"
DUPLICATE_FIELD = "duplicate"
