"""Table operators: schedules, identity, consensus, audits, planning, readers and personalisation."""
