"""The small labelled sets that the published quality figures are over, in their own order."""

# fmt: off
#: id, kind, text
CORPUS = (
    ("checkout-outage", "decision", "checkout was unavailable for forty minutes after the friday afternoon deploy"),
    ("deploy-freeze", "decision", "no production deploys after thursday noon until a release gate exists"),
    ("canary-gate", "decision", "every release must pass a canary on five percent of traffic before full rollout"),
    ("rollback-runbook", "node", "to roll back, promote the previous image tag and drain the old pods"),
    ("deploy-window", "node", "the agreed release window is tuesday and wednesday, ten in the morning to four"),
    ("oncall-rota", "node", "primary and secondary rotate weekly with a handover note on friday"),
    ("sre-headcount", "decision", "approved two additional site reliability engineers for the platform team"),
    ("migration-lock", "decision", "the orders table migration held an exclusive lock and stalled writes for nine minutes"),
    ("online-ddl", "decision", "schema changes must use online DDL and never take an exclusive table lock"),
    ("index-orders-created", "node", "added a btree index on orders.created_at to stop the nightly report scanning the table"),
    ("connection-pool", "node", "the pool is capped at eighty connections per instance and queues beyond that"),
    ("replica-lag", "decision", "reads that must be fresh go to the primary, because replica lag reaches four seconds under load"),
    ("backup-schedule", "node", "full backup nightly at two, incremental every hour, retained for thirty days"),
    ("session-expiry", "decision", "idle sessions expire after twelve hours rather than thirty days"),
    ("token-rotation", "decision", "signing keys rotate every ninety days with an overlap window of one week"),
    ("logout-bug", "decision", "logging out did not clear the refresh token, so a stolen token stayed valid"),
    ("auth-runbook", "node", "to revoke a compromised session, delete the refresh token row and bump the key version"),
    ("mfa-rollout", "decision", "multi factor authentication became mandatory for anyone with production access"),
    ("alert-fatigue", "decision", "alerts that fired more than ten times a week without action were deleted"),
    ("trace-sampling", "decision", "sample traces at one percent normally and one hundred percent for errors"),
    ("dashboard-latency", "node", "the latency dashboard shows p50, p95 and p99 for every public endpoint"),
    ("log-retention", "node", "application logs are kept for fourteen days and then deleted"),
    ("cafeteria-menu", "node", "the cafeteria deploys a new menu every wednesday and serves laksa on fridays"),
    ("office-move", "node", "the team moves to the third floor in march, desks by the window"),
    ("laptop-refresh", "node", "laptops older than four years are replaced on request"),
    ("bike-shed", "node", "the bike shed will be repainted blue after a lengthy discussion"),
    ("expense-policy", "node", "expenses over two hundred need a manager approval before submission"),
    ("coffee-machine", "node", "the coffee machine on the second floor is broken again and a ticket is open"),
    ("parking-permit", "node", "parking permits renew in january and cost nothing for cyclists"),
    ("team-offsite", "node", "the offsite is in june, two days, agenda to be decided"),
    ("stationery-order", "node", "stationery orders go through the office manager every second week"),
    ("plant-watering", "node", "the plants are watered on mondays by whoever arrives first"),
    ("fire-drill", "node", "the fire drill is scheduled for the last thursday of the quarter"),
    ("welcome-pack", "node", "new joiners get a welcome pack with a mug and a lanyard"),
)
#: source, target, type, weight
EDGES = (
    ("checkout-outage", "deploy-freeze", "CAUSED", 0.95),
    ("deploy-freeze", "canary-gate", "CAUSED", 0.9),
    ("checkout-outage", "sre-headcount", "INFLUENCED", 0.6),
    ("checkout-outage", "rollback-runbook", "CAUSED", 0.8),
    ("migration-lock", "online-ddl", "CAUSED", 0.95),
    ("migration-lock", "index-orders-created", "INFLUENCED", 0.5),
    ("replica-lag", "connection-pool", "INFLUENCED", 0.4),
    ("logout-bug", "session-expiry", "CAUSED", 0.9),
    ("logout-bug", "auth-runbook", "CAUSED", 0.85),
    ("logout-bug", "token-rotation", "INFLUENCED", 0.7),
    ("alert-fatigue", "trace-sampling", "INFLUENCED", 0.5),
)
#: id, query, relevant, irrelevant
QUERIES = (
    ('q01', 'checkout outage after the friday deploy', ['checkout-outage', 'deploy-freeze', 'sre-headcount', 'rollback-runbook'], ['cafeteria-menu']),
    ('q02', 'why did we stop deploying on fridays', ['deploy-freeze', 'checkout-outage', 'canary-gate'], ['deploy-window', 'cafeteria-menu']),
    ('q03', 'canary rollout requirement before full traffic', ['canary-gate', 'deploy-freeze'], []),
    ('q04', 'how do I roll back a bad release', ['rollback-runbook', 'checkout-outage'], []),
    ('q05', 'exclusive table lock stalled writes', ['migration-lock', 'online-ddl', 'index-orders-created'], []),
    ('q06', 'schema change policy online DDL', ['online-ddl', 'migration-lock'], []),
    ('q07', 'replica lag and reading fresh data', ['replica-lag', 'connection-pool'], []),
    ('q08', 'nightly report scanning the orders table', ['index-orders-created', 'migration-lock'], []),
    ('q09', 'stolen refresh token stayed valid after logout', ['logout-bug', 'session-expiry', 'auth-runbook', 'token-rotation'], []),
    ('q10', 'how long before an idle session expires', ['session-expiry', 'logout-bug'], []),
    ('q11', 'revoke a compromised session', ['auth-runbook', 'logout-bug'], []),
    ('q12', 'signing key rotation window', ['token-rotation', 'logout-bug'], []),
    ('q13', 'multi factor for production access', ['mfa-rollout'], []),
    ('q14', 'noisy alerts that nobody acts on', ['alert-fatigue', 'trace-sampling'], []),
    ('q15', 'trace sampling rate for errors', ['trace-sampling', 'alert-fatigue'], []),
    ('q16', 'how long are application logs kept', ['log-retention'], []),
    ('q17', 'kubernetes ingress certificate renewal', [], ['token-rotation']),
    ('q18', 'quarterly revenue forecast by region', [], []),
    ('q19', 'graphql schema stitching strategy', [], ['online-ddl']),
)
#: id, name, type, property
RECORDS = (
    ("inc-1a", "checkout outage after friday deploy", "incident", ("service", "checkout")),
    ("inc-1b", "friday deploy took checkout down", "incident", ("service", "checkout")),
    ("svc-2a", "site reliability engineering rota", "doc", ("team", "platform")),
    ("svc-2b", "sre rota", "doc", ("team", "platform")),
    ("db-3a", "postgres migration lock timeout", "incident", ("service", "orders")),
    ("db-3b", "postgress migration lock timout", "incident", ("service", "orders")),
    ("per-4a", "jon smith", "person", ("team", "platform")),
    ("per-4b", "smith, jon a", "person", ("team", "platform")),
    ("per-5a", "catherine oleary", "person", ("team", "data")),
    ("per-5b", "katherine olery", "person", ("team", "data")),
    ("dep-6a", "deploy gate", "decision", ("area", "release")),
    ("dep-6b", "deploy gate", "runbook", ("area", "release")),
    ("nm-7a", "orders table migration", "incident", ("service", "orders")),
    ("nm-7b", "orders table index rebuild", "incident", ("service", "orders")),
    ("nm-8a", "session expiry twelve hours", "decision", ("area", "auth")),
    ("nm-8b", "session expiry thirty days", "decision", ("area", "auth")),
    ("hard-9a", "p1 checkout unavailable forty minutes", "incident", ("service", "checkout")),
    ("hard-9b", "the friday outage", "incident", ("service", "checkout")),
    ("noise-1", "cafeteria menu wednesday", "doc", ("area", "office")),
    ("noise-2", "parking permit renewal", "doc", ("area", "office")),
    ("noise-3", "laptop refresh policy", "doc", ("area", "office")),
    ("noise-4", "fire drill schedule", "doc", ("area", "office")),
    ("noise-5", "welcome pack contents", "doc", ("area", "office")),
    ("noise-6", "bike shed colour", "doc", ("area", "office")),
    ("noise-7", "stationery order process", "doc", ("area", "office")),
    ("noise-8", "plant watering rota", "doc", ("area", "office")),
)
#: a, b
DUPLICATES = (
    ("inc-1a", "inc-1b"),
    ("svc-2a", "svc-2b"),
    ("db-3a", "db-3b"),
    ("per-4a", "per-4b"),
    ("per-5a", "per-5b"),
    ("hard-9a", "hard-9b"),
)
#: id, name, type
LINK_RECORDS = (
    ("d-friday", "we stopped shipping on fridays", "decision"),
    ("d-gate", "we added a pre-deploy gate", "decision"),
    ("d-rollback", "we made rollback a one-command operation", "decision"),
    ("d-oncall", "we moved to a follow-the-sun on-call rota", "decision"),
    ("d-postmortem", "every incident gets a written postmortem", "decision"),
    ("i-checkout", "the checkout outage of 14 March", "node"),
    ("i-payments", "the payments latency spike in April", "node"),
    ("i-search", "search returned empty results for two hours", "node"),
    ("svc-checkout", "the checkout service", "node"),
    ("svc-payments", "the payments service", "node"),
    ("svc-search", "the search indexer", "node"),
    ("team-platform", "the platform team", "node"),
    ("team-growth", "the growth team", "node"),
    ("doc-runbook", "the incident response runbook", "node"),
    ("doc-slo", "the service level objective document", "node"),
    ("proj-migration", "the postgres migration project", "node"),
    ("proj-checkout-rewrite", "the checkout rewrite", "node"),
    ("vendor-cdn", "the CDN provider contract", "node"),
    ("q1-review", "the first quarter reliability review", "node"),
    ("q2-review", "the second quarter reliability review", "node"),
)
#: mention, record or None, family
MENTIONS = (
    ("the checkout service", "svc-checkout", "exact"),
    ("the platform team", "team-platform", "exact"),
    ("the checkout rewrite", "proj-checkout-rewrite", "exact"),
    ("the checkout outage", "i-checkout", "partial"),
    ("payments latency", "i-payments", "partial"),
    ("a pre-deploy gate", "d-gate", "partial"),
    ("the postgres migration", "proj-migration", "partial"),
    ("the incident response runbook", "doc-runbook", "exact"),
    ("no friday releases", "d-friday", "reworded"),
    ("one-command rollback", "d-rollback", "reworded"),
    ("the search indexing job", "svc-search", "reworded"),
    ("written postmortems for incidents", "d-postmortem", "reworded"),
    ("the follow the sun rota", "d-oncall", "reworded"),
    ("the SLO doc", "doc-slo", "abbreviation"),
    ("the CDN contract", "vendor-cdn", "abbreviation"),
    ("the reliability review", "q1-review", "ambiguous"),
    ("the checkout problem", "i-checkout", "ambiguous"),
    ("the checkout redesign workshop", None, "nil-near"),
    ("the payments team", None, "nil-near"),
    ("the third quarter reliability review", None, "nil-near"),
    ("the search rewrite", None, "nil-near"),
    ("the deploy freeze policy", None, "nil-near"),
    ("the cafeteria menu rotation", None, "nil-far"),
    ("quantum tunnelling", None, "nil-far"),
)
#: id, family, text, relations (predicate, subject, object)
TEXTS = (
    ('s1', 'stated-causal', 'The friday deploy caused a checkout outage.', [('CAUSED', 'The friday deploy', 'a checkout outage')]),
    ('s2', 'stated-causal', 'The expired certificate led to a login failure.', [('CAUSED', 'The expired certificate', 'a login failure')]),
    ('s3', 'stated-causal', 'The schema migration resulted in a read timeout.', [('CAUSED', 'The schema migration', 'a read timeout')]),
    ('s4', 'stated-influence', 'The March postmortem informed the rollback policy.', [('INFLUENCED', 'The March postmortem', 'the rollback policy')]),
    ('s5', 'stated-influence', 'The cost review shaped the vendor decision.', [('INFLUENCED', 'The cost review', 'the vendor decision')]),
    ('s6', 'stated-precedent', 'The payments rollout set a precedent for later launches.', [('PRECEDENT_FOR', 'The payments rollout', 'later launches')]),
    ('m1', 'stated-multiple', 'The friday deploy caused a checkout outage. The outage informed the gate.', [('CAUSED', 'The friday deploy', 'a checkout outage'), ('INFLUENCED', 'The outage', 'the gate')]),
    ('m2', 'stated-multiple', 'The audit informed the rewrite. The rewrite set a precedent for later builds.', [('INFLUENCED', 'The audit', 'the rewrite'), ('PRECEDENT_FOR', 'The rewrite', 'later builds')]),
    ('n1', 'negative-cooccurrence', 'Present: Alice, Bob, Carol, Dave, Erin, Frank, Grace, Heidi, Ivan, Judy.', []),
    ('n2', 'negative-cooccurrence', 'The checkout service, the payments service and the search indexer were all reviewed.', []),
    ('n3', 'negative-cooccurrence', 'Attendees: the platform team, the growth team, the on-call rota owner.', []),
    ('g1', 'negative-negated', 'The friday deploy did not cause the checkout outage.', []),
    ('g2', 'negative-negated', 'Nobody believes the migration caused the timeout.', []),
    ('g2b', 'negative-negated', 'The friday deploy never caused the checkout outage.', []),
    ('g5b', 'negative-question', 'Whether the deploy caused the outage is still open.', []),
    ('g3', 'negative-hedged', 'The deploy may have caused the outage.', []),
    ('g4', 'negative-hedged', 'It is unclear whether the certificate caused the failure.', []),
    ('g5', 'negative-question', 'Did the friday deploy cause the checkout outage?', []),
    ('p1', 'negative-narrative', 'We shipped on friday. Checkout was down for two hours. The postmortem is written.', []),
    ('p2', 'negative-narrative', 'The rollback policy is documented in the runbook and reviewed each quarter.', []),
    ('p3', 'negative-narrative', 'Parking permit renewal happens every January.', []),
    ('sc1', 'scope-other-clause', 'The deploy caused the outage, which was not detected for an hour.', [('CAUSED', 'The deploy', 'the outage')]),
    ('sc2', 'scope-other-clause', 'It is not raining and the deploy caused the outage.', [('CAUSED', 'the deploy', 'the outage')]),
    ('sc3', 'scope-other-clause', 'The rollback did not prevent the failure; the deploy caused the outage.', [('CAUSED', 'the deploy', 'the outage')]),
    ('ps1', 'pseudo-negation', 'No one disputes that the deploy caused the outage.', [('CAUSED', 'the deploy', 'the outage')]),
    ('cf1', 'negative-counterfactual', 'Had the deploy caused the outage, we would have rolled back.', []),
    ('nq1', 'negative-question', 'The report questions whether the migration caused the timeout.', []),
    ('nn1', 'negative-negated', 'Nothing suggests the deploy caused the outage.', []),
    ('nn2', 'negative-negated', 'We cannot say the deploy caused the outage.', []),
    ('nh1', 'negative-hedged', 'The deploy allegedly caused the outage.', []),
    ('pr1', 'stated-parenthetical', 'The audit, if thorough, informed the rewrite.', [('INFLUENCED', 'The audit', 'the rewrite')]),
)
